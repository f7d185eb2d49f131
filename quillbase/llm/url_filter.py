"""URL filters: a trie over reversed host labels, then path, with longest-match precedence.

Rules (verdict, host, path) go into one trie: host labels from the right, and at the host's node the rule's path, by its
segments; the last segment matches as a prefix, so /en/7 fits /en/75/a. A rule fits its host and all subdomains. Of the
rules that fit a url the one with most host labels wins, then the one with the longest path; a block rule wins over an
equal allow rule. The trie is broadcast behind a check of its size. A longer list stays a table: its paths from the
trie's root (host suffix, then path prefix) are join keys, each host's lengths of path say which prefixes of a url can be
keys at all, and the same order decides between those found; both ways give the same verdicts.

Defined cases: a null url, or one without ://, has empty host and path and no rule; only A-Z are lower-cased; user info
and ports stay part of the host; equal urls get equal answers; the caller's columns are kept, and one whose name is that
of a verdict's column goes on under own_ and its name; an empty rule list leaves every verdict to the default.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import documents, own_columns, quoted, staged, whole_row

#: Bytes of pickled trie that may be broadcast, and rules of a table that may be read for one.
MAX_BYTES, MAX_RULES = 64 << 20, 500_000
RULE = 0  # a node's rules are kept under this key, its children under strings

#: The contract's list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_LOWER = {c: c + 32 for c in range(65, 91)}


def build(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dictionaries: labels from the right; RULE -> path segments -> RULE -> (prefix, rule, verdict), longest first."""
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        if path and not path.startswith("/"):
            raise ValueError(f"a rule's path starts with /: {path!r}")
        node, host = root, host.translate(_LOWER)
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *segments, last = path.split("/")[1:] or [""]
        node = node.setdefault(RULE, {})
        for s in segments:
            node = node.setdefault(s, {})
        entry = (last if path else None, host + path, verdict)
        kept = [e for e in node.get(RULE, ()) if e[0] != entry[0] or e[2] == "block" != verdict]
        if not any(e[0] == entry[0] for e in kept):
            kept.append(entry)
        node[RULE] = sorted(kept, key=lambda e: -1 if e[0] is None else len(e[0]), reverse=True)
    return root


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    node, paths = trie, []
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if RULE in node:
            paths.append(node[RULE])
    for node in reversed(paths):  # most host labels first
        rest, found = (path.split("/")[1:] if path.startswith("/") else []), None
        for depth in range(len(rest) + 1):
            left = "/".join(rest[depth:]) if depth < len(rest) else None
            for prefix, rule, verdict in node.get(RULE, ()):
                if prefix is None or (left is not None and left.startswith(prefix)):
                    found = (rule, verdict)
                    break
            if depth == len(rest) or rest[depth] not in node:
                break
            node = node[rest[depth]]
        if found:
            return found
    return None


VERDICT = ("host", "path", "rule", "verdict")


def _parsed(urls: DataFrame, url: str) -> DataFrame:
    """`_row`, host and path."""
    after = F.when(F.instr("_url", "://") > 0, F.substring("_url", F.instr("_url", "://") + 3, F.length("_url")))
    parts = urls.select(whole_row(urls), F.col(quoted(url)).alias("_url")).select("_row", after.alias("_after"))
    host = F.translate(F.regexp_extract("_after", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return parts.select("_row", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))


def _by_trie(parts: DataFrame, trie: dict, default: str) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        held = shared.value
        got = [lookup(held, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(got, columns=["rule", "verdict"], dtype=object)

    return parts.withColumn("_v", judged("host", "path")).select("_row", "host", "path", "_v.rule", "_v.verdict")


def _by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For lists too long to broadcast. Distinct urls meet the rules, so a url's copies are one row until the last join."""
    suffix = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    list_ = staged(rules.select(suffix.alias("suffix"), F.col("path").alias("prefix"), (F.col("verdict") == "block").alias("block")).groupBy("suffix", "prefix").agg(F.max("block").alias("block")), "rules")
    lengths = list_.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    seen = staged(parts.select("host", "path").distinct(), "urls")
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("labels"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("suffix")))
    hosts = seen.select("host", "path", F.explode(ends).alias("e")).select("host", "path", "e.*").join(lengths, "suffix")
    keys = hosts.select("host", "path", "labels", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    keys = keys.withColumn("prefix", F.substring("path", F.lit(1), F.col("n")))
    best = F.max(F.struct("labels", "n", "block", F.concat("suffix", "prefix").alias("rule"))).alias("best")
    judged = staged(keys.join(list_, ["suffix", "prefix"]).groupBy("host", "path").agg(best), "judged")
    verdict = F.when(F.col("best").isNull(), default).otherwise(F.when(F.col("best.block"), "block").otherwise("allow"))
    return parts.join(judged, ["host", "path"], "left").select("_row", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _judged(urls: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, default: str, url: str) -> DataFrame:
    """`_row` and the columns of VERDICT."""
    parts = _parsed(urls, url)
    if isinstance(rules, DataFrame):
        some = rules.select("verdict", "host", "path").limit(MAX_RULES + 1).collect()
        if len(some) > MAX_RULES:
            return _by_join(parts, rules, default)
        rules = some
    rules = [tuple(r) for r in rules]
    trie = build(rules)
    if len(pickle.dumps(trie)) <= MAX_BYTES:
        return _by_trie(parts, trie, default)
    return _by_join(parts, urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)


def with_verdicts(urls: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """`urls` with host, path, rule and verdict; rules: (verdict, host, path), as a list or a table."""
    names, taken = [], {c.lower() for c in urls.columns} | set(VERDICT)
    for c in urls.columns:
        name = c
        while name.lower() in VERDICT or (name != c and name.lower() in taken):
            name = f"own_{name}"
        names.append(name)
        taken.add(name.lower())
    own = [F.col("_row").getField(c).alias(n) for c, n in zip(urls.columns, names, strict=True)]
    return _judged(urls, rules, default, url).select(*own, *VERDICT)


def filter_urls(urls: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Rows whose url is allowed, with their own columns."""
    return _judged(urls, rules, default, url).where("verdict = 'allow'").select(*own_columns(urls.columns))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(documents(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


#: The same result in DuckDB.
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), w AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM v
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM w
"""
