"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame expressions only.

Base kinds are regular expressions. The method looks at every other run of at least 20 token characters. It infers the
encoding (the smallest of ALPHABETS that holds the run) and tests the null "drawn evenly and independently from that
alphabet" three ways: chi-squared against the uniform alphabet, the number of runs of character classes (both tails), and
the lag-1 serial correlation of symbol indices (both tails). Fisher's method joins the three p-values; a run looks random
if the joint p-value is not small.

That a structured run looks random by chance is controlled over the whole corpus. Structured runs of known kind are
tested beside the candidates: REFERENCE runs made by rule for each spelling and length, and those glued from all words of
all texts, each word once. A candidate's p-value is the share of structured runs of its alphabet and class of length that
look at least as random (a conformal p-value, so nothing is assumed of the battery's distribution), and
Benjamini-Hochberg over all candidates keeps the share of false discoveries at `fdr`. Short runs, of which structured ones pass more often,
thus need a better score than long ones. Only counts by alphabet, class of length and step of the score reach the driver.

Spans and scores of candidates are written to the shared folder before the threshold is known. Structured runs, of
which there are far more, are only counted: their scores come from a second reading of the texts, a row for each run and
step by step, so that Spark compiles all but the sums over a run's symbols (lambdas are interpreted).

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive; spans of a text are ordered
by start, then kind; a random run that overlaps a base span is not reported; equal texts get equal spans, whatever
their ids; other columns, whatever their names, travel in one struct and are kept by `redact`; texts of any length and
number of spans are handled in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import documents, own_columns, quoted, staged, text_or_empty

KINDS = ("assign", "access", "hex", "random")
#: pattern, group whose length counts, least length
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    # a match of [0-9a-f]+ is a whole run, so asking for the length inside the pattern changes nothing
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
#: A whole run, with up to two '=' after it where they can be padding; a run may follow '=' or stand before it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])(?:={1,2}(?![A-Za-z0-9+/_=-]))?"

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: symbols in order, pattern of the runs that they hold, sizes of their classes; base64url's two extra count as base64's
ALPHABETS = (
    (_DIGIT + "abcdef", "^[0-9a-f]+$", (10, 6)),
    (_DIGIT + "ABCDEF", "^[0-9A-F]+$", (10, 6)),
    (_UPPER + "234567", "^[A-Z2-7]+$", (26, 6)),
    (_LOWER + _DIGIT, "^[a-z0-9]+$", (26, 10)),
    (_UPPER + _DIGIT, "^[A-Z0-9]+$", (26, 10)),
    (_UPPER + _LOWER + _DIGIT, "^[A-Za-z0-9]+$", (26, 26, 10)),
    (_UPPER + _LOWER + _DIGIT + "+/", ".", (26, 26, 10, 2)),
)
#: Least lengths of the classes of length.
LENGTHS = (20, 24, 32, 48, 64)
#: Structured runs made by rule for each of SPELLINGS and LENGTHS.
REFERENCE = 600
#: Share of false discoveries allowed among the random spans.
FDR = 0.01
#: -log10 of the joint p-value is counted in steps of 1 / STEPS up to CEILING.
STEPS, CEILING = 20, 40
#: Values summed, and code points masked, at a time.
BLOCK, PAGE = 128, 4096


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(values: Sequence, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


_NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _running(sizes: Column) -> Column:
    """Sums of all earlier values, by blocks, so that a long array is not copied for each of its values."""

    def sums(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, state, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    part = lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    totals = F.transform(blocks, lambda i: F.aggregate(part(i), F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.transform(sums(totals, F.lit(0)), lambda start, i: sums(part(i), start)))


def _spans(text: Column, kind: int, pattern: str, group: int, least: int, matches: Column | None = None) -> Column:
    """Spans of the pattern's matches (found here if not given): gaps and matches alternate, so their lengths give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if matches is None else matches
    counted = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def located(m: Column) -> Column:
        def of_parts(parts: Column) -> Column:
            starts = _bind(F.transform(parts, lambda p: p["gap"] + p["size"]), _running)
            found = F.zip_with(starts, parts, lambda at, p: F.when(p["counted"] >= least, F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["size"]).alias("end"))))
            return F.filter(found, lambda s: s.isNotNull())

        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), F.length)
        return _bind(F.arrays_zip(gaps.alias("gap"), F.transform(m, F.length).alias("size"), F.transform(counted, F.length).alias("counted")), of_parts)

    return _bind(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(_NO_SPANS)).otherwise(located(m)))


def _normal_below(z: Column) -> Column:
    """The normal distribution function (Zelen and Severo's 7.5e-8 approximation; for tails below 1e-7, the asymptotic bound)."""
    a = F.abs(z)
    t, density = 1 / (1 + 0.2316419 * a), F.exp(-a * a / 2) * 0.3989422804014327
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.when(a > 5, density / a).otherwise(density * series)
    return F.when(z < 0, upper).otherwise(1 - upper)


def _both_tails(z: Column) -> Column:
    return 2 * _normal_below(-F.abs(z))


def _changes(classes: Sequence[int]) -> tuple[float, float]:
    """Probability that neighbours of an even, independent draw differ in class, and the covariance of two such events in a row."""
    share = [c / sum(classes) for c in classes]
    rate = 1 - sum(p * p for p in share)
    return rate, sum(p * (1 - p) ** 2 for p in share) - rate * rate


def battery(token: Column) -> Column:
    """struct(alphabet, n, chi, runs, serial, p): the three p-values of a run under an even, independent draw, and Fisher's of them."""
    return reduce(_bind, BATTERY, token)


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


#: For each alphabet, the index of each of its symbols at the symbol's code.
_INDICES = f"array({', '.join('array(' + ', '.join(f'{x[0].find(chr(c))}D' for c in range(ord('z') + 1)) + ')' for x in ALPHABETS)})"


def _trimmed(token: Column) -> Column:
    return F.struct(F.rtrim(token, F.lit("=")).alias("run"))


def _spelled(s: Column) -> Column:
    """A run's alphabet, its text with base64's symbols for base64url's, and the changes of class in it."""
    which = F.lit(len(ALPHABETS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ALPHABETS[:-1]))):
        which = F.when(s["run"].rlike(pattern), F.lit(i)).otherwise(which)
    # in every alphabet the classes are capitals, small letters, digits and the rest
    changes = (F.length(F.regexp_replace(s["run"], "[A-Z]+|[a-z]+|[0-9]+|[+/_-]+", ".")) - 1).cast("double")
    text = F.replace(F.replace(s["run"], F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.struct(which.alias("alphabet"), text.alias("text"), changes.alias("changes"), F.octet_length(s["run"]).alias("n"))


def _counted(s: Column) -> Column:
    """Besides, sums over the numbers of a run's distinct symbols and over its symbols' indices in the alphabet."""

    def squares(text: Column, chars: Column, n: Column) -> Column:
        numbers = F.transform(F.array_distinct(chars), lambda c: (n - F.octet_length(F.replace(text, c, F.lit("")))).cast("double"))
        return _total(numbers, lambda k: k * k)

    def of_chars(chars: Column) -> Column:
        v = _bind(F.get(F.expr(_INDICES), s["alphabet"]), lambda at: F.transform(chars, lambda c: F.get(at, F.ascii(c))))
        of_text = lambda text: _bind(s["n"], lambda n: squares(text, chars, n))
        return F.struct(_bind(s["text"], of_text).alias("squares"), v.alias("v"))

    def of_indices(squares: Column, v: Column) -> Column:
        products = _total(F.sequence(F.lit(1), s["n"] - 1), lambda i: F.get(v, i - 1) * F.get(v, i))
        sums = {"squares": squares, "s": _total(v, lambda x: x), "q": _total(v, lambda x: x * x), "xy": products, "first": F.get(v, F.lit(0)), "last": F.get(v, s["n"] - 1)}
        return F.struct(*[s[k].alias(k) for k in ("alphabet", "n", "changes")], *[c.alias(k) for k, c in sums.items()])

    return _bind(_bind(F.split(s["text"], ""), of_chars), lambda t: _bind(t["v"], lambda v: of_indices(t["squares"], v)))


def _deviates(c: Column) -> Column:
    """The tests' statistics as deviates of the normal distribution."""
    a, n = c["alphabet"], c["n"].cast("double")
    size = _pick([float(len(x[0])) for x in ALPHABETS], a)
    free = size - 1  # degrees of freedom; Wilson and Hilferty's cube root
    chi = -(F.pow(F.greatest(size / n * c["squares"] - n, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    rate, together = (_pick([_changes(x[2])[i] for x in ALPHABETS], a) for i in (0, 1))
    runs = (c["changes"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate) + 2 * (n - 2) * together)
    m, x, y, xx, yy = n - 1, c["s"] - c["last"], c["s"] - c["first"], c["q"] - c["last"] * c["last"], c["q"] - c["first"] * c["first"]
    spread = (m * xx - x * x) * (m * yy - y * y)
    r = F.when(spread > 0, (m * c["xy"] - x * y) / F.sqrt(spread)).otherwise(1.0)
    return F.struct(a.alias("alphabet"), c["n"].alias("n"), chi.alias("chi"), runs.alias("runs"), ((r + 1 / m) * F.sqrt(m)).alias("serial"))


def _tails(z: Column) -> Column:
    tails = {"chi": _normal_below(z["chi"]), "runs": _both_tails(z["runs"]), "serial": _both_tails(z["serial"])}
    return F.struct(z["alphabet"].alias("alphabet"), z["n"].alias("n"), *[F.greatest(p, F.lit(1e-300)).alias(k) for k, p in tails.items()])


def _fisher(s: Column) -> Column:
    x = -(F.log(s["chi"]) + F.log(s["runs"]) + F.log(s["serial"]))
    return F.struct(*[s[k].alias(k) for k in ("alphabet", "n", "chi", "runs", "serial")], (F.exp(-x) * (1 + x + x * x / 2)).alias("p"))


def _placed(b: Column) -> Column:
    """struct(cell, step): alphabet and class of length as one number, and how far the run is from looking random."""
    length = sum((b["n"] >= least).cast("int") for least in LENGTHS[1:])
    step = F.floor(F.least(-F.log10(F.greatest(b["p"], F.lit(1e-300))), F.lit(float(CEILING))) * STEPS).cast("int")
    return F.struct((b["alphabet"] * len(LENGTHS) + length).alias("cell"), F.greatest(step, F.lit(0)).alias("step"))


#: Steps of the battery, each from what the one before returns.
BATTERY = (_trimmed, _spelled, _counted, _deviates, _tails, _fisher)


def _cell(token: Column) -> Column:
    return _bind(battery(token), _placed)


def cells(runs: DataFrame, column: str) -> DataFrame:
    """Column `c`: the cell of each row's run. Step by step, so that Spark compiles what is a lambda's body in `_cell`."""
    runs = runs.select(F.col(column).alias("c"))
    for step in (*BATTERY, _placed):
        runs = runs.select(step(F.col("c")).alias("c"))
    return runs


# -- structured runs

#: Words that the rule-made runs are put together from.
_WORDS = (
    "about access account address album answer archive article author balance battery button calendar camera category center change channel chapter client "
    "column comment company config content control country courage culture default degree delivery design detail device display document driver editor element "
    "engine example factor feature field filter finance folder format function garden general global handler header history image import index input interface "
    "journal kernel label language layer letter library listing manager market measure member message method module monitor network number object option order "
    "output package parameter person picture player policy position process product profile project quality query reader record region report request resource "
    "result return sample schedule school science season section server service session setting shadow simple single source station status storage student "
    "summary support system table target template theory thread title traffic update user value version view village visitor volume weather window winter worker"
).split()
_HEX_WORDS = "added badge bead beef cafe caged cede dead deed decade deface face facade faded fed feed".split()
#: separator, spelling: how the words of a rule-made run are put together
SPELLINGS = (("", "lower"), ("-", "lower"), ("_", "lower"), ("/", "lower"), ("", "title"), ("", "upper"), ("", "title+number"), ("", "lower+number"), ("", "upper+number"), ("", "digits"), ("", "hex"))


def reference(spark: SparkSession) -> DataFrame:
    """Column `run`: REFERENCE structured runs for each of SPELLINGS and LENGTHS, made by rule."""
    n = len(SPELLINGS) * len(LENGTHS)
    rows = spark.range(REFERENCE * n, numPartitions=spark.sparkContext.defaultParallelism)
    kind, length = (F.col("id") % len(SPELLINGS)).cast("int"), (F.floor(F.col("id") / len(SPELLINGS)) % len(LENGTHS)).cast("int")
    draw = lambda k, of: F.pmod(F.xxhash64("id", k), F.lit(of)).cast("int")
    how = _pick([s[1] for s in SPELLINGS], kind)

    def word(k: Column) -> Column:
        plain = F.when(how == "hex", _pick(_HEX_WORDS, draw(k, len(_HEX_WORDS)))).otherwise(_pick(_WORDS, draw(k, len(_WORDS))))
        cased = F.when(how.startswith("title"), F.initcap(plain)).when(how.startswith("upper"), F.upper(plain)).otherwise(plain)
        number = F.when(how.endswith("number") & (draw(k + 100, 2) == 0), draw(k + 200, 100).cast("string")).when((how == "hex") & (draw(k + 100, 2) == 0), draw(k + 200, 10).cast("string")).otherwise("")
        return F.when(how == "digits", F.abs(F.xxhash64("id", k) % 1_000_000_007).cast("string")).otherwise(F.concat(cased, number))

    glued = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), word), "\0")
    glued = F.translate(F.replace(glued, F.lit("\0"), _pick([s[0] for s in SPELLINGS], kind)), "\0", "")
    return rows.select(F.substring(glued, F.lit(1), _length_in(length, F.xxhash64("id", F.lit(-1)))).alias("run"))


#: Words in a lot; the last lot of a text has up to twice as many.
GLUED = 64


def _length_in(length: Column, h: Column) -> Column:
    """A length within a class, by a hash."""
    ends = [*LENGTHS[1:], 2 * LENGTHS[-1]]
    return _pick(LENGTHS, length) + F.pmod(h, _pick([b - a for a, b in zip(LENGTHS, ends)], length)).cast("int")


def _glued(text: Column) -> Column:
    """Structured runs from all words of the text itself, each word in one of them; none if all words make no run of 20.

    What holds a digit, or a run long enough to be a candidate, is no word. Words are taken by lots of GLUED, which have
    the five spellings and the classes of length in turn; what is left of a lot lengthens its last run.
    """

    def of_lot(words: Column, turn: Column) -> Column:
        kind, length = F.pmod(turn, F.lit(5)).cast("int"), F.pmod(F.floor(turn / 5), F.lit(len(LENGTHS))).cast("int")
        cased = F.when(kind == 3, F.initcap(words)).when(kind == 4, F.upper(words)).otherwise(words)
        run = F.replace(cased, F.lit(" "), _pick(["", "-", "/", "", ""], kind))
        return _bind(F.struct(run.alias("run"), _length_in(length, F.xxhash64(words)).alias("n")), lambda s: cut(s["run"], s["n"]))

    def cut(run: Column, n: Column) -> Column:
        of_last = lambda last: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(run, i * n + 1, F.when(i == last, F.octet_length(run)).otherwise(n)))
        return _bind(F.greatest(F.floor(F.octet_length(run) / n).cast("int") - 1, F.lit(0)), of_last)

    def lots(words: Column) -> Column:
        last = F.greatest(F.floor(F.size(words) / GLUED).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * GLUED + 1, F.when(i == last, F.size(words)).otherwise(GLUED)), " "))

    plain = F.filter(F.split(text, r"\s+"), lambda w: ~w.rlike("[0-9]") & ((F.octet_length(w) < LENGTHS[0]) | ~w.rlike(f"[A-Za-z+/_-]{{{LENGTHS[0]}}}")))
    words = F.regexp_extract_all(F.array_join(plain, " "), F.lit("[A-Za-z]+"), F.lit(0))
    first = F.pmod(F.xxhash64(text), F.lit(5 * len(LENGTHS)))
    runs = _bind(first, lambda h: F.flatten(F.transform(_bind(words, lots), lambda lot, i: of_lot(lot, h + i))))
    return F.filter(runs, lambda r: F.octet_length(r) >= LENGTHS[0])


# -- scanning


def candidates(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`_row` (the columns), `_base` spans, `_runs` (spans of candidates), their `_cells`, and `_decoys` (structured runs)."""
    t, tokens = F.col("_text"), F.col("_tokens")
    found = docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("_row"), text_or_empty().alias("_text"))
    found = found.select("_row", "_text", F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("_tokens"))
    base = {name: _spans(t, k, *PATTERNS[name]) for k, name in enumerate(KINDS[:3])}
    # 32 hexadecimal digits in a row are part of a candidate
    base["hex"] = F.when(F.exists(tokens, lambda x: x.rlike("[0-9a-f]{32}")), base["hex"]).otherwise(F.array().cast(_NO_SPANS))
    return found.select(
        "_row",
        F.concat(*base.values()).alias("_base"),
        _spans(t, 3, CANDIDATE, 0, 20, tokens).alias("_runs"),
        F.transform(tokens, _cell).alias("_cells"),
        _glued(t).alias("_decoys"),
    )


def structured(runs: DataFrame) -> DataFrame:
    """Column `run`: a row for each of `_decoys`. For `explode`, Spark would make the arrays twice, to leave empty ones out."""
    return runs.select(F.explode_outer("_decoys").alias("run")).where("run IS NOT NULL")


def accepted(counts: Iterable[tuple[int, int, int, int]], fdr: float) -> dict[int, int]:
    """From (cell, step, candidates, structured runs): the greatest step of each cell that Benjamini-Hochberg accepts."""
    cells: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for cell, step, k, d in counts:
        cells[cell].append((step, k, d))
    ranked, total = [], 0
    for cell, rows in cells.items():
        below, decoys = 0, sum(d for _, _, d in rows)
        for step, k, d in sorted(rows):
            below += d
            total += k
            ranked.append(((1 + below) / (1 + decoys), cell, step, k))
    found, most = 0, -1.0
    for p, _, _, k in sorted(ranked):
        found += k
        if k and p <= fdr * found / total:
            most = p
    out: dict[int, int] = {}
    for p, cell, step, _ in ranked:
        if p <= most:
            out[cell] = max(step, out.get(cell, -1))
    return out


def thresholds(scored: DataFrame, runs: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """`accepted` of the counts over all candidates (`_cells`) and structured runs (`_decoys`, and those made by rule); at most
    len(ALPHABETS) * len(LENGTHS) * CEILING * STEPS rows are collected.
    """
    own = scored.select(F.explode("_cells").alias("c"), F.lit(False).alias("decoy"))
    others = cells(structured(runs).unionByName(reference(runs.sparkSession)), "run").withColumn("decoy", F.lit(True))
    counted = own.unionByName(others).groupBy("c.cell", "c.step")
    rows = counted.agg(F.count_if(~F.col("decoy")).alias("k"), F.count_if("decoy").alias("d")).collect()
    return accepted([(r["cell"], r["step"], r["k"], r["d"]) for r in rows], fdr)


def scan(docs: DataFrame, columns: Sequence[str] | None = None, fdr: float = FDR) -> DataFrame:
    """`_row` (all columns, or some), `base` and `spans`: arrays of (start, kind index, end). `docs` is read twice."""
    every = candidates(docs, docs.columns if columns is None else columns)
    found = staged(every.drop("_decoys"), "candidates")
    least = thresholds(found, every, fdr)
    steps = [least.get(c, -1) for c in range(len(ALPHABETS) * len(LENGTHS))]
    flagged = F.filter(F.zip_with("_runs", "_cells", lambda r, c: F.when(c["step"] <= _pick(steps, c["cell"]), r)), lambda r: r.isNotNull())
    rows = found.select("_row", F.sort_array("_base").alias("base"), flagged.alias("_random"))
    clear = F.filter("_random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select("_row", "base", F.sort_array(F.concat("base", clear)).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), ("doc_id",))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "_row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with each union of overlapping or adjoining spans, given in order, replaced by `mark`; by pages of PAGE code points."""

    def page(part: Column, i: Column) -> Column:
        first = i * PAGE
        own = F.filter(spans, lambda s: (s["start"] < first + PAGE) & (s["end"] >= first))

        def step(acc: Column, s: Column) -> Column:
            begin = F.greatest(acc["last"], first)
            gap = F.substring(part, begin - first + 1, F.greatest(s["start"] - begin, F.lit(0)))
            fresh = (s["start"] > acc["last"]) & (s["start"] >= first)
            return F.struct(F.greatest(acc["last"], s["end"]).alias("last"), F.concat(acc["out"], gap, F.when(fresh, mark).otherwise("")).alias("out"))

        state = F.struct(F.lit(-1).alias("last"), F.lit("").alias("out"))
        return F.aggregate(own, state, step, lambda acc: F.concat(acc["out"], F.substring(part, F.greatest(acc["last"], first) - first + 1, F.lit(PAGE))))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)), page), "")


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each union of overlapping spans replaced by `mark`; all columns stay."""
    text = F.col("_row.text")
    clean = F.when(F.size("spans") == 0, text).otherwise(_masked(text, F.col("spans"), mark))
    return scan(docs, None, fdr).select(*own_columns(docs.columns, text=clean))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked."""
    return redact(docs)
