"""Best-fit packing by bin completion over a histogram of piece lengths.

Only 2048 lengths exist, so the search works on their counts. It takes the largest length left and enumerates, least waste
first, the fillings of the room beside it that no other dominates (Martello and Toth: none whose pieces, in groups, fit
into another one's pieces). A decision is a filling and how many sequences get it: all that the counts allow, half, a
quarter ... or one. The first descent, always the least waste and as often as it goes, is the best-fit incumbent. While it
needs more sequences than a lower bound (the sum of lengths, and Martello and Toth's L2) branch-and-bound revisits any
decision, by limited discrepancy: first all packings that leave the descent once, then twice, and so on, cut off where the
waste so far cannot beat the incumbent. The search is over when the bound is met, when nothing was left out (the packing
is then optimal), or after EFFORT units of work, a unit being one decision over one length; more effort never harms. The
search's size depends on the number of lengths, never on the number of documents; pieces find their place by their rank
within their length, with one small join.

The strings of the vocabulary's special tokens are ordinary text, as in token files; `special=True` gives their ids.

Defined cases: a null text is an empty one, which is one piece with the end id alone; repeated rows and repeated ids are
packed as often as they come; pieces of one length are interchangeable, so ties only decide which sequence of equal
makeup a piece goes to; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import documents, encoder, give_back, staged, text_blocks, text_or_empty, vocabulary

ROOM = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Decisions times lengths after which the search for a better packing ends.
EFFORT = 600_000
#: Bytes of text encoded at once.
BLOCK = 8 << 20


def pieces(docs: DataFrame, vocabulary_file: str, room: int = ROOM, end: int = END, special: bool = False) -> DataFrame:
    """Every document's ids and end id, cut into pieces; `nth` counts the pieces of a length within the partition `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(vocabulary_file, False, special=special), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, texts in text_blocks(batch.column("text"), BLOCK):
                for doc, whole in zip(ids[i:], tokens.encode(texts), strict=False):
                    whole += last
                    for k, at in enumerate(range(0, len(whole), 4 * room)):
                        cut = whole[at : at + 4 * room]
                        n = len(cut) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(cut), part, seen.setdefault(n, 0)))
                        seen[n] += 1
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def _reachable(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each i the sums up to `room` of pieces of lengths[i:], as the bits of a number."""
    out, sums, most = [1] * (len(lengths) + 1), 1, (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        n, left, k = lengths[i], min(counts[lengths[i]], room // lengths[i]), 1
        while left:  # 1, 2, 4 ... pieces at once
            k = min(k, left)
            sums |= sums << n * k & most
            left, k = left - k, 2 * k
        out[i] = sums
    return out


def _exact(lengths: list[int], counts: dict[int, int], reach: list[int], i: int, left: int) -> Iterator[tuple[int, ...]]:
    """Pieces of lengths[i:] of sum `left`, the largest first; every branch leads to one."""
    if not left:
        yield ()
        return
    while reach[i] >> left & 1:
        n = lengths[i]
        for k in range(min(counts[n], left // n), 0, -1):
            if reach[i + 1] >> left - n * k & 1:
                for rest in _exact(lengths, counts, reach, i + 1, left - n * k):
                    yield (n,) * k + rest
        i += 1


def dominated(filling: tuple[int, ...], counts: dict[int, int], waste: int) -> bool:
    """Whether a piece that is left could take the place of some of the filling's (or of none) in the same room.

    That is Martello and Toth's dominance, a step at a time: pieces of sum x - waste to x give way to one of length x.
    Two or more of sum x do so too, as smaller pieces are easier to place.
    """
    one, many = 0, 0  # sums of single pieces, of several
    for n in filling:
        many |= (many | one) << n
        one |= 1 << n
    left = 0
    for n, c in counts.items():
        if c > filling.count(n):
            left |= 1 << n
    if left & many:
        return True
    less = (one | many | 1) << 1  # 1 to `waste` more
    reach = 1
    while reach < waste:
        step = min(reach, waste - reach)
        less |= less << step
        reach += step
    return bool(waste and left & less)


def completions(counts: dict[int, int], room: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, pieces) of the undominated fillings of `room`, least waste first, then largest pieces first."""
    if counts.get(room):
        yield 0, (room,)  # one piece that fits exactly dominates all else
        return
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    reach = _reachable(lengths, counts, room)
    for waste in range(room + 1):
        if reach[0] >> room - waste & 1:
            for filling in _exact(lengths, counts, reach, 0, room - waste):
                if not dominated(filling, {n: counts[n] for n in lengths}, waste):
                    yield waste, filling


@dataclass(frozen=True)
class Pattern:
    """`times` sequences, each of these lengths."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(histogram: dict[int, int], room: int = ROOM) -> int:
    """Sequences that any packing needs: the sum of lengths, and L2 (for each k, pieces over half a room beside those under k)."""
    counts = np.zeros(room + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(room + 1))
    best = -(-int(total[-1]) // room)
    half = room // 2
    for k in range(half + 1):
        alone = int(number[room] - number[room - k])  # over room - k: no piece of k or more fits beside
        large, sum_large = int(number[room - k] - number[half]), int(total[room - k] - total[half])
        small = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - (large * room - sum_large)) // room)))
    return best


class _Search:
    """Limited discrepancy search over decisions (filling, times)."""

    def __init__(self, histogram: dict[int, int], room: int, effort: int):
        self.room, self.effort, self.cut = room, effort, False
        self.counts = {n: c for n, c in histogram.items() if c}
        self.total = sum(n * c for n, c in self.counts.items())
        self.best: list[Pattern] = []
        self.used = 0

    def sequences(self) -> int:
        return sum(p.times for p in self.best)

    def options(self, counts: dict[int, int]) -> Iterator[Pattern]:
        """Decisions for the largest length: fillings by waste, each as often as it goes, half as often ... once."""
        top = max(counts)
        rest = dict(counts)
        rest[top] -= 1
        for _, filling in completions(rest, self.room - top):
            lengths = (top, *filling)
            times = min(counts[n] // lengths.count(n) for n in set(lengths))
            while times:
                yield Pattern(lengths, times)
                times //= 2

    def apply(self, counts: dict[int, int], p: Pattern) -> int:
        """Takes the pattern's pieces out of `counts`; its waste."""
        for n in set(p.lengths):
            counts[n] -= p.times * p.lengths.count(n)
            if not counts[n]:
                del counts[n]
        return p.times * (self.room - sum(p.lengths))

    def allowed(self) -> float:
        return (self.sequences() - 1) * self.room - self.total if self.best else float("inf")

    def wave(self, counts: dict[int, int], done: list[Pattern], wasted: int, discrepancies: int) -> None:
        """All packings that begin with `done` and leave the first options so many times."""
        begin, start, first = len(done), dict(counts), list(done)
        spent = [wasted]
        while counts and wasted <= self.allowed():
            self.used += 1
            p = next(self.options(counts))
            wasted += self.apply(counts, p)
            first.append(p)
            spent.append(wasted)
        if not counts and wasted <= self.allowed():
            self.best = first
        for k, p in enumerate(first[begin:]):
            if self.done():
                return
            if spent[k] > self.allowed():
                break
            for i, other in enumerate(self.options(start)):
                if i == 0:
                    continue
                if spent[k] + self.room - sum(other.lengths) > self.allowed():
                    break  # fillings come by waste, so no later one will do
                if not discrepancies:
                    self.cut = True
                    break
                branch = dict(start)
                waste = self.apply(branch, other)
                if spent[k] + waste <= self.allowed():
                    self.wave(branch, [*first[: begin + k], other], spent[k] + waste, discrepancies - 1)
                if self.done():
                    return
            self.apply(start, p)

    def done(self) -> bool:
        return self.sequences() <= self.need or self.used * (len(self.counts) + 10) > self.effort

    def run(self) -> list[Pattern]:
        self.need = lower_bound(self.counts, self.room)
        self.wave(dict(self.counts), [], 0, 0)
        discrepancies = 1
        while self.cut and not self.done():
            self.cut = False
            self.wave(dict(self.counts), [], 0, discrepancies)
            discrepancies += 1
        return self.best


def solve(histogram: dict[int, int], room: int = ROOM, effort: int = EFFORT) -> list[Pattern]:
    """Patterns that use every piece of the histogram once."""
    return _Search(histogram, room, effort).run()


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> for its uses in order: first rank, pieces a sequence, first sequence, offset within a sequence."""
    uses: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    base = 0
    for p in patterns:
        offset = 0
        for n in dict.fromkeys(p.lengths):
            k = p.lengths.count(n)
            uses.setdefault(n, []).append((at.get(n, 0), k, base, offset))
            at[n] = at.get(n, 0) + k * p.times
            offset += k * n
        base += p.times
    return {n: tuple(np.array(c, np.int64) for c in zip(*u, strict=True)) for n, u in uses.items()}


def place(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """`pieces`, written out, with sequence_id and offset."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n")).persist()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `room` rows at most
    places = _places(solve(histogram, room))
    shared = cut.sparkSession.sparkContext.broadcast(places)  # a few entries for each length
    before = counts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY part ROWS UNBOUNDED PRECEDING) - n")).drop("n")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, each, base, inside = shared.value[int(n)]
                use = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[use]
                sequence[rows] = base[use] + nth // each[use]
                offset[rows] = inside[use] + nth % each[use] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence), pa.array(offset)], names=names)

    ranked = cut.join(before, ["part", "length"]).select(*names[:5], (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary_file: str | None = None, special: bool = False) -> DataFrame:
    """Pieces and their places; `special`: strings of special tokens in a text become those tokens."""
    return place(staged(pieces(docs, vocabulary_file or vocabulary("word_bpe_49k.json"), special=special), "pieces"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the documents' pieces and their places."""
    return pack(docs)
