"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of whole texts are built-in expressions evaluated inside the row: no shuffle, no Python. A decision list is
learned from labelled statistics by sequential covering: each rule is a conjunction of thresholds, grown on two thirds
of a bounded sample by information gain, pruned on the remaining third, and the rows it covers are removed before the
next rule is grown. The list becomes one ordered `CASE WHEN` expression that Spark evaluates while it scans.

Defined cases: a null text has no words; an empty or wordless text has statistics 0 and fails the base rule; ties in
gain go to the first statistic in FEATURES and the lowest threshold; rows are judged one by one, so repeated rows and
repeated ids get equal answers; of rows that share a labelled id the one of least text is learned from; other columns of
the input, whatever their names, travel in one struct and are kept; with no documents or no labels the list is empty and
only the base rule rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import documents, own_columns, text_or_empty, whole_row

#: White space of the word rule: code points 32 and 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

FEATURES = (
    "symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word_length", "upper_ratio", "punctuation_ratio", "digit_ratio",
    "distinct_ratio", "words_per_line", "short_word_ratio", "n_words",
)


def _bind(value: Column, body) -> Column:
    """`body` of a value computed once, however often and wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more."""

    def of_windows(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == x["h"])
            marked = F.filter(F.transform(s, lambda x, i: F.when(same(x, i, i - 1) | same(x, i, i + 1), x["i"])), lambda p: p.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda p: F.array(p, p + 1, p + 2)))))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(pairs, of_sorted))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_bind(windows, of_windows))

    return _bind(words, of_words)


def statistics(docs: DataFrame) -> DataFrame:
    """`_row` (the input's columns), the base counts and FEATURES of every whole text.

    Windows are compared by a 64-bit hash of their three words, within one text.
    """
    one = docs.select(whole_row(docs), text_or_empty().alias("_text"))
    two = one.select(
        "_row",
        "_text",
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("_lines"),
    )
    three = two.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count("_text", F.lit("[.,;:!?]")).alias("_punctuation"),
        F.regexp_count("_text", F.lit("[0-9]")).alias("_digits"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        F.size(F.filter("_words", lambda w: F.length(w) <= 2)).alias("_short"),
    )
    per = lambda x, of: (F.col(x) / F.greatest(F.col(of), F.lit(1))).cast("double")
    return three.select(
        "_row",
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("word_chars", "n_words").alias("mean_word_length"),
        per("_upper", "word_chars").alias("upper_ratio"),
        per("_punctuation", "word_chars").alias("punctuation_ratio"),
        per("_digits", "word_chars").alias("digit_ratio"),
        per("_distinct", "n_words").alias("distinct_ratio"),
        per("n_words", "_n_lines").alias("words_per_line"),
        per("_short", "n_words").alias("short_word_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """All conditions hold: reject. `precision` and `covered` are measured on the pruning rows."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        whole = self.conditions[0].column()
        for c in self.conditions[1:]:
            whole = whole & c.column()
        return whole


class _Cuts:
    """Every threshold of every statistic: its rows in rising order, and where its values change."""

    def __init__(self, x: dict[str, np.ndarray]):
        self.order = {f: np.argsort(v, kind="stable") for f, v in x.items()}
        self.ends = {f: np.flatnonzero(np.diff(v[self.order[f]]) > 0) for f, v in x.items()}
        self.x = x

    def best(self, covered: np.ndarray, bad: np.ndarray, least: int) -> Condition | None:
        """The condition of greatest information gain on the covered rows, if any gains."""
        good, hits = (covered & ~bad).astype(np.int64), (covered & bad).astype(np.int64)
        p0, n0 = hits.sum(), good.sum()
        top, found = 1e-9, None
        for f, order in self.order.items():
            ends = self.ends[f]
            p_low, n_low = np.cumsum(hits[order])[ends], np.cumsum(good[order])[ends]
            for above, p, n in ((True, p0 - p_low, n0 - n_low), (False, p_low, n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= least, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                if len(gain) and gain.max() > top:
                    k = int(gain.argmax())
                    v = self.x[f][order[ends[k] : ends[k] + 2]]
                    top, found = gain[k], Condition(f, above, float((v[0] + v[1]) / 2) if v[0] < (v[0] + v[1]) / 2 < v[1] else float(v[0]))
        return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, least: int = 8, precision: float = 0.97) -> list[Rule]:
    """Sequential covering of the rows marked `bad`, until every one of the growing rows is covered or was tried.

    A rule is grown over all thresholds of all statistics until it covers no good row or none gains, then loses its last
    conditions while that doesn't worsen (hits - misses) / covered on the pruning rows. It enters the list if it covers
    `least` rows in all, some of them pruning rows, and `precision` of them are bad on both parts; the rows of one that
    fails are set aside, and the next rule is grown from the others.
    """
    growing = np.arange(len(bad)) % 3 != 2
    open_, tried, rules = np.ones(len(bad), bool), np.zeros(len(bad), bool), []
    cuts = _Cuts(x)
    while (open_ & growing & bad & ~tried).any():
        covered, conditions = open_ & growing & ~(tried & bad), []
        while (covered & ~bad).any() and (condition := cuts.best(covered, bad, least // 2)):
            conditions.append(condition)
            covered = covered & condition.holds(x)
        if not conditions:
            break

        def measured(cs: list[Condition], part: np.ndarray) -> tuple[float, float, int]:
            hold = open_ & part & np.logical_and.reduce([c.holds(x) for c in cs])
            p, n = int((hold & bad).sum()), int((hold & ~bad).sum())
            return (p - n) / max(1, p + n), p / max(1, p + n), p + n

        grown = covered & bad
        while len(conditions) > 1 and measured(conditions[:-1], ~growing)[0] >= measured(conditions, ~growing)[0]:
            conditions.pop()
        _, on_pruning, n = measured(conditions, ~growing)
        _, on_growing, m = measured(conditions, growing)
        if n and n + m >= least and min(on_growing, on_pruning) >= precision:
            rules.append(Rule(tuple(conditions), on_pruning, n))
            open_ &= ~rules[-1].holds(x)
        else:
            tried |= grown
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Statistics of at most `rows` documents, one for each labelled id, those of least hashed id; the broadcast side has `rows` rows at most."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return statistics(held.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = 6000, **how) -> list[Rule]:
    """A decision list from at most `rows` labelled documents (a bounded sample, 12 numbers each on the driver)."""
    got = labelled_sample(docs, labels, rows).select("_row.doc_id", "_row.quality", *FEATURES).collect()
    got.sort(key=lambda r: ((r["doc_id"] * 2654435761) % 2**32, r["doc_id"]))
    x = {f: np.array([r[f] for r in got], float) for f in FEATURES}
    bad = np.array([r["quality"] == 0 for r in got], bool)
    passed = ~((x["n_words"] < 50) | (x["repeat_ratio"] > 0.5))  # what the base rule rejects needs no learning
    return learn({f: v[passed] for f, v in x.items()}, bad[passed], **how)


def verdict(rules: list[Rule]) -> Column:
    """1 + the index of the first rule that holds, as one ordered conditional expression; 0 if none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for i, r in enumerate(rules[1:], 2):
        out = out.when(r.column(), F.lit(i))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`_row`, statistics, `base_failed`, the `rule` that rejects (0: none) and `kept`."""
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    judged = judge(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return judged.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def filter_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Documents that the base rule and the list keep, with their own columns."""
    return judge(docs, rules).where("kept").select(*own_columns(docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return filter_quality(docs, fit(docs, documents(spark, sf_dir, "labels")))
