"""Suffix-array dedup: maximal repeats from common-prefix interval trees over partitioned enhanced suffix arrays.

Two equal strings of LENGTH bytes share the least hash of their GRAM-byte grams (minimum substring partitioning), so the
suffixes of the corpus fall into buckets by that hash, and a common-prefix interval of depth LENGTH or more lies in one
bucket. Neighbouring suffixes of one bucket form a run, which is located by (text, start, count) and carries a digest
of its bytes; runs of over MOST suffixes (periodic text) are cut. One aggregation over the buckets drops those of a single
run, and equal runs become one leaf with a multiplicity. A bucket of one leaf is a tree of one interval, the run itself,
and needs no look at the text. Of the others the leaves' bytes are fetched, each once, and the enhanced suffix array of
each bucket is built: suffixes in order (equal windows of LENGTH bytes first, then what follows them by prefix doubling,
until no class splits any more), common prefixes from the levels of the doubling, and a stack scan of the interval tree
that tests the left extensions of an interval's suffixes. The maximal repeats come out with all their occurrences: each
suffix under its deepest one, the others being the tree's ancestors.

A bucket of over WIDE suffixes (one passage amid ever other text) is thinned out first: windows that come once in the
bucket are in no repeat, an aggregation over window hashes finds them, and what is left of its runs are new leaves, now of
the passage alone. Where even those are over WIDE, each of their windows is reported as a repeat of LENGTH bytes.

Gram hashes are polynomial, 64 bits, over random byte values; runs and windows are identified by two, of different bases.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; matches never cross texts; equal texts are
located by one 128-bit key, so repeated rows and repeated ids are copies of each other and get equal values; overlapping
occurrences count; in `deduplicate` a character cut apart at a span's edge goes whole, other columns, whatever their
names, stay, and a row stays even if its text becomes empty; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import GOLDEN, U64, documents, map_arrow, mix, own_columns, runs, staged, text_bytes, text_or_empty, whole_row, width

LENGTH = 200
GRAM = 64
#: Bytes of text hashed, and suffixes put into one suffix array, at a time.
BLOCK, ARRAY = 1 << 17, 1 << 18
#: Suffixes of leaves beyond which a bucket is thinned out.
WIDE = 1 << 18
#: Suffixes of a run.
MOST = 1 << 12
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_LOOP = 1 << 31
RUNS = "k1 long, k2 long, at long, h long, d long"


class _Hash:
    """Polynomial hashes of any substring of a block, from prefix sums modulo 2 ** 64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        base = _BASES[which]
        n = len(data) + 1
        if which not in self._powers or len(self._powers[which][0]) < n:
            back = pow(base, -1, 1 << 64)
            size = max(n, 2 * BLOCK)
            up, down = (np.cumprod(np.r_[U64(1), np.full(size - 1, b, U64)], dtype=U64) for b in (base, back))
            self._powers[which] = (up, down)
        up, self.down = (p[:n] for p in self._powers[which])
        table = mix(np.arange(1, 257, dtype=U64) * GOLDEN + U64(which))
        self.sums = np.zeros(n, U64)
        np.cumsum(table[data] * up[:-1], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of the substring of that length at each place."""
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U64) * GOLDEN)


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    span = 1
    while span * 2 <= window:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = window - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def block_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in it, suffixes, whether its least gram comes twice, bucket, digest) of the runs of a block of texts."""
    n = len(data)
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool), none, none
    grams = _Hash(data, 0).every(gram)
    bits = U64(max(1, int(n).bit_length()))
    low = (U64(1) << bits) - U64(1)
    least = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=U64), length - gram + 1) & low).astype(np.int64)
    edge = np.zeros(n + 2, np.int64)
    long = sizes >= length
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    places = np.flatnonzero(np.cumsum(edge[: n - length + 1]) > 0)
    place = least[places]
    value = grams[place]
    same = np.r_[False, (places[1:] == places[:-1] + 1) & (value[1:] == value[:-1])]
    first = np.flatnonzero(~same)
    if len(first) and np.diff(np.r_[first, len(places)]).max() > MOST:
        nth = np.arange(len(places)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(places))))
        same &= nth % MOST != 0
        first = np.flatnonzero(~same)
    count = np.diff(np.r_[first, len(places)])
    moved = np.r_[False, place[1:] != place[:-1]] & same
    loop = np.add.reduceat(moved.astype(np.int64), first) > 0
    start = places[first]
    text = np.searchsorted(offsets, start, "right") - 1
    digest = _Hash(data, 1).of(start, start + count + length - 1)
    return text, start - offsets[text], count, loop, value[first].view(np.int64), digest.view(np.int64)


def _key(text: Column) -> list[Column]:
    """128 bits that equal texts share, as two longs."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"k{i + 1}") for i in (0, 1)]


def located_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """RUNS of every text; `at` packs the start (32 bits), the loop mark (1) and the number of suffixes (31)."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
        out = []
        for i, j in runs(np.diff(offsets).tolist(), BLOCK):
            text, start, count, loop, h, d = block_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
            out.append((k1[text + i], k2[text + i], start << 32 | np.where(loop, _LOOP, 0) | count, h, d))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k1", "k2", "at", "h", "d"])

    text = text_or_empty()
    return map_arrow(docs.select(*_key(text), text.alias("text")), of_batch, RUNS)


class SuffixArray:
    """The suffixes of some strings that have `length` bytes or more left, in order, and the common prefix of each with the one before.

    The order is that of classes of equal windows of `length` bytes (any order, as no interval of that depth crosses them),
    then that of the bytes that follow, to the end of the suffix's own string, which counts as less than any byte.
    """

    def __init__(self, parts: list[bytes], length: int):
        sizes = np.array([len(p) for p in parts])
        counts = np.maximum(sizes - length + 1, 0)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.run = np.repeat(np.arange(len(parts)), counts)
        self.begin = np.arange(self.bounds[-1]) - self.bounds[self.run]
        n = len(self.run)
        whole = np.frombuffer(b"".join(parts), np.uint8)
        at = self.begin + (np.cumsum(sizes) - sizes)[self.run]
        self.left = np.where(self.begin > 0, whole[at - 1].astype(np.int64), -1)  # what lies left of a run is another bucket's
        window = np.zeros(n, np.int64)
        for k in range(2):
            _, own = np.unique(_Hash(whole, k).every(length)[at], return_inverse=True)
            _, window = np.unique(window << 32 | own, return_inverse=True)
        ends = self.bounds[1:][self.run] - 1  # where nothing follows the window
        where = np.arange(n)
        tail = np.where(where < ends, whole[np.minimum(at + length, len(whole) - 1)].astype(np.uint16) + 1, 0)
        self.levels = self._doubled(np.r_[tail, np.zeros(8, np.uint16)], ends, int(counts.max()) - 1)
        self.order = np.lexsort((self.levels[-1][1], window))
        a, b = self.order[:-1], self.order[1:]
        self.prefix = np.r_[0, np.where(window[a] == window[b], length + self._common(a, b, tail, ends), 0)] if n else np.zeros(0, np.int64)

    @staticmethod
    def _doubled(tail: np.ndarray, ends: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
        """(bytes, rank by so many bytes), doubling until the ranks are those of whole tails."""
        n = len(ends)
        where, key = np.arange(n), np.zeros(n, U64)
        for i in range(7):  # seven 9-bit symbols
            key = key << U64(9) | np.where(where + i < ends, tail[i : n + i], 0).astype(U64)
        values, rank = np.unique(key, return_inverse=True)
        levels, span, classes = [(7, rank)], 7, len(values)
        while span < longest and classes < n:
            next_ = np.where(where + span < ends, rank[np.minimum(where + span, n - 1)] + 1, 0)
            values, rank = np.unique(rank.astype(U64) << U64(32) | next_.astype(U64), return_inverse=True)
            if len(values) == classes:
                break
            span, classes = span * 2, len(values)
            levels.append((span, rank))
        return levels

    def _common(self, a: np.ndarray, b: np.ndarray, tail: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Common prefix of the tails at a and b."""
        done, last = np.zeros(len(a), np.int64), len(tail) - 1
        room = np.minimum(ends[a] - a, ends[b] - b)
        for span, rank in [self.levels[-1], *reversed(self.levels)]:  # the last level may fit more than once
            while True:
                equal = (done < room) & (rank[np.minimum(a + done, last)] == rank[np.minimum(b + done, last)])
                done = np.where(equal, done + span, done)
                if span != self.levels[-1][0] or not equal.any():
                    break
        for _ in range(6):
            done = np.where((done < room) & (tail[np.minimum(a + done, last)] == tail[np.minimum(b + done, last)]), done + 1, done)
        return np.minimum(done, room)


class IntervalTree:
    """The common-prefix intervals of at least a depth, by a stack scan; an interval is maximal if its left extensions differ.

    An interval is open while prefixes stay at its depth or above, and passes what it saw on the left to the interval around
    it. `left` is the byte before each suffix; negative values differ from everything, themselves included. `own` is each
    suffix's deepest interval, -1 for none; an interval's parent has a greater number only if it was opened later.
    """

    def __init__(self, prefix: np.ndarray, left: np.ndarray, least: int):
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.maximal: list[bool] = []
        self.own = np.full(len(prefix), -1, np.int64)
        closed: list[int] = []
        starts = np.flatnonzero(prefix >= least)
        if not len(starts):
            return
        begins = starts[np.r_[True, np.diff(starts) > 1]] - 1
        stops = starts[np.r_[np.diff(starts) > 1, True]]
        for begin, stop in zip(begins.tolist(), stops.tolist(), strict=True):
            depths, sides = prefix[begin + 1 : stop + 1].tolist(), left[begin : stop + 1].tolist()
            stack: list[list] = []  # depth, left byte seen, whether left bytes differ, number
            own, before = [], 0
            for k, depth in enumerate([*depths, 0]):
                side, differ, inner = sides[k], sides[k] < 0, -1
                if before > depth:
                    own.append(stack[-1][3])
                while stack and stack[-1][0] > depth:
                    _, s, x, number = stack.pop()
                    x = x or differ or s != side
                    self.maximal[number] = x
                    closed.append(number)
                    if inner >= 0:
                        self.parent[inner] = number
                    side, differ, inner = s, x, number
                if stack and stack[-1][0] == depth:
                    top = stack[-1]
                    top[2] = top[2] or differ or top[1] != side
                elif depth >= least:
                    stack.append([depth, side, differ, len(self.depth)])
                    self.depth.append(depth)
                    self.parent.append(-1)
                    self.maximal.append(False)
                if inner >= 0 and stack:
                    self.parent[inner] = stack[-1][3]
                if before <= depth:
                    own.append(stack[-1][3])
                before = depth
            self.own[begin : stop + 1] = own
        self._lift(closed)

    def _lift(self, closed: list[int]) -> None:
        """Parents and `own` to the nearest maximal interval. A parent closes after its children."""
        nearest = np.full(len(self.depth) + 1, -1, np.int64)
        for i in reversed(closed):
            up = nearest[self.parent[i]] if self.parent[i] >= 0 else -1
            self.parent[i] = int(up)
            nearest[i] = i if self.maximal[i] else up
        self.own = nearest[self.own]  # -1 is the last entry, which is -1

    def around(self, i: int) -> Iterator[int]:
        """A maximal interval and the maximal ones around it."""
        while i >= 0:
            yield i
            i = self.parent[i]


def repeats_in_runs(parts: list[bytes], counts: list[int], length: int, listed: bool = True) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(depth, [(run, place)]) of every maximal repeat among runs; a run that comes more than once is one as a whole.

    Without `listed`, a place stands under its deepest repeat only: the same bytes, and no more places than suffixes.
    """
    array = SuffixArray(parts, length)
    tree = IntervalTree(array.prefix, array.left[array.order], length)
    members: dict[int, list[tuple[int, int]]] = {}
    some = np.flatnonzero(tree.own >= 0)
    at = array.order[some]
    for i, run, begin in zip(tree.own[some].tolist(), array.run[at].tolist(), array.begin[at].tolist(), strict=True):
        for j in tree.around(i) if listed else (i,):
            members.setdefault(j, []).append((run, begin))
    for i, places in members.items():
        yield tree.depth[i], places
    for i, c in enumerate(counts):
        if c > 1:
            yield len(parts[i]), [(i, 0)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


GROUPS = "h long, d long, places array<struct<begin:int,size:int,repeat:binary>>"


def _groups(length: int, listed: bool):
    """Rows (h, d, c, part) in order of h, d -> GROUPS: the maximal repeats of each leaf."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        h, d, counts, parts = (list(c) for c in zip(*rows, strict=True))
        run, begin, size, name = [], [], [], []
        for depth, members in repeats_in_runs(parts, counts, length, listed):
            r, at = members[0]
            name += [hashlib.blake2b(parts[r][at : at + depth], digest_size=16).digest()] * len(members)
            run += [m[0] for m in members]
            begin += [m[1] for m in members]
            size += [depth] * len(members)
        order = np.argsort(np.array(run, np.int64), kind="stable")
        run, begin, size = (np.array(x, np.int64)[order] for x in (run, begin, size))
        which, first = np.unique(run, return_index=True)
        kinds = [("begin", pa.int32()), ("size", pa.int32()), ("repeat", pa.binary())]
        values = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(size, pa.int32()), pa.array([name[i] for i in order], pa.binary())], fields=[pa.field(*k) for k in kinds])
        places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(run)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array(np.array(h, np.int64)[which]), pa.array(np.array(d, np.int64)[which]), places], names=["h", "d", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "c", "part")), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue
                if size > ARRAY and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) - length + 1
        if held:
            yield solve(held)

    return run


def _solved(leaves: DataFrame, length: int, listed: bool) -> DataFrame:
    """GROUPS of leaves (h, d, c, part)."""
    n = width(leaves.sparkSession)
    return leaves.select("h", "d", "c", "part").repartition(n, "h").sortWithinPartitions("h", "d").mapInArrow(_groups(length, listed), GROUPS)


def _thinned(leaves: DataFrame, length: int, listed: bool) -> DataFrame:
    """GROUPS of the leaves of wide buckets, from the stretches of their windows that come twice in the bucket."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for h, d, c, part in zip(*(batch.column(x).to_pylist() for x in ("h", "d", "c", "part")), strict=True):
            data = np.frombuffer(part, np.uint8)
            p1, p2 = (_Hash(data, i).every(length).view(np.int64) for i in (0, 1))
            n = len(p1)
            out.append((np.full(n, h), np.full(n, d), np.full(n, c), np.arange(n, dtype=np.int32), p1, p2))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["h", "d", "c", "begin", "p1", "p2"])

    def stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for h, d, c, part, begins in zip(*(batch.column(x).to_pylist() for x in ("h", "d", "c", "part", "begins")), strict=True):
            at = np.array(begins)
            first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            for a, b in zip(at[first].tolist(), at[np.r_[first[1:] - 1, len(at) - 1]].tolist(), strict=True):
                piece = part[a : b + length]
                out.append((h, d, c, a, int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big", signed=True), piece))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["h", "d", "c", "begin", "e", "part"])

    every = staged(map_arrow(leaves, windows, "h long, d long, c long, begin int, p1 long, p2 long"), "windows")
    often = staged(every.groupBy("h", "p1", "p2").agg(F.sum("c").alias("n")).where("n > 1").select("h", "p1", "p2"), "often")
    repeated = every.join(often, ["h", "p1", "p2"]).select("h", "d", "begin", "p1", "p2")
    begins = repeated.groupBy("h", "d").agg(F.sort_array(F.collect_list("begin")).alias("begins"))
    pieces = staged(map_arrow(leaves.join(begins, ["h", "d"]), stretches, "h long, d long, c long, begin int, e long, part binary"), "pieces")
    anew = staged(pieces.groupBy("h", "e").agg(F.sum("c").alias("c"), F.min("part").alias("part")), "leaves")
    hot = staged(anew.groupBy("h").agg(F.sum(F.length("part") - length + 1).alias("n")).where(F.col("n") > WIDE).select("h"), "hot")
    own = _solved(anew.join(hot, "h", "left_anti").withColumnRenamed("e", "d"), length, listed).withColumnRenamed("d", "e")
    found = pieces.select("h", "d", "begin", "e").join(own, ["h", "e"]).select("h", "d", "begin", F.explode("places").alias("p"))
    found = found.select("h", "d", F.struct((F.col("begin") + F.col("p.begin")).alias("begin"), F.col("p.size").alias("size"), F.col("p.repeat").alias("repeat")).alias("place"))
    name = F.unhex(F.concat(F.lpad(F.hex("p1"), 16, "0"), F.lpad(F.hex("p2"), 16, "0")))
    rest = repeated.join(hot, "h").select("h", "d", F.struct("begin", F.lit(length).alias("size"), name.alias("repeat")).alias("place"))
    return found.unionByName(rest).groupBy("h", "d").agg(F.sort_array(F.collect_list("place")).alias("places"))


def occurrences(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, listed: bool = True) -> DataFrame:
    """k1, k2, begin, size, repeat: all occurrences of all maximal repeats, as far as their buckets' runs reach.

    Repeats of equal `repeat` are one group. Longer repeats are a text's overlapping occurrences together. Without
    `listed`, an occurrence stands under the deepest repeat that begins there only; the bytes covered are the same.
    """
    located = located_runs(docs, length, gram)
    loop = F.col("at").bitwiseAND(_LOOP) != 0
    several = located.groupBy("h").agg(F.count("*").alias("runs"), F.min("d").alias("low"), F.max("d").alias("high"), F.max(loop).alias("loop"))
    several = several.where("runs > 1 OR loop").select("h", ((F.col("low") == F.col("high")) & ~F.col("loop")).alias("single"))
    several = staged(several, "buckets")  # a join of two plain shuffles, so that AQE can split a hot bucket
    shared = staged(located.join(several, "h"), "runs")
    count, start = F.col("at").bitwiseAND(_LOOP - 1), F.shiftright("at", 32)

    distinct = shared.where(~F.col("single")).groupBy("h", "d").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "at")).alias("best"))
    distinct = staged(distinct.select("h", "d", "c", "best.k1", "best.k2", "best.at"), "distinct")
    wide = staged(distinct.groupBy("h").agg(F.sum(count).alias("suffixes")).where(F.col("suffixes") > WIDE).select("h", F.lit(True).alias("wide")), "wide")
    leaves = distinct.join(wide, "h", "left")
    wanted = leaves.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "d", "c", start.alias("start"), count.alias("n"), F.col("wide").isNotNull().alias("wide"))).alias("runs"))
    text = text_or_empty()
    keyed = docs.select(*_key(text), "doc_id", text.alias("text"))
    holder = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("holder"))  # of copies, the one that is read
    wanted = wanted.join(holder, ["k1", "k2"])
    found = keyed.join(wanted, (keyed["k1"] == wanted["k1"]) & (keyed["k2"] == wanted["k2"]) & keyed["doc_id"].eqNullSafe(wanted["holder"])).select(wanted["k1"], wanted["k2"], "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for *key, text, own in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "runs")), strict=True):
                if key != last:  # rows of one id and text
                    data, last = text.encode(), key
                    rows += [(r["h"], r["d"], r["c"], r["wide"], data[r["start"] : r["start"] + r["n"] + length - 1]) for r in own]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h", "d", "c", "wide", "part"])

    parts = staged(found.mapInArrow(cut, "h long, d long, c long, wide boolean, part binary"), "parts")
    groups = _solved(parts.where(~F.col("wide")), length, listed)
    if parts.where("wide").limit(1).count():
        groups = groups.unionByName(_thinned(parts.where("wide").dropDuplicates(["h", "d"]), length, listed))
    groups = staged(groups, "groups")

    whole = F.unhex(F.concat(F.lpad(F.hex("h"), 16, "0"), F.lpad(F.hex("d"), 16, "0")))
    single = shared.where("single").select("k1", "k2", start.alias("begin"), (count + length - 1).alias("size"), whole.alias("repeat"))
    mixed = shared.where(~F.col("single")).select("k1", "k2", start.alias("start"), "h", "d").join(groups, ["h", "d"]).select("k1", "k2", "start", F.explode("places").alias("p"))
    mixed = mixed.select("k1", "k2", (F.col("start") + F.col("p.begin")).alias("begin"), F.col("p.size").cast("long").alias("size"), F.col("p.repeat").alias("repeat"))
    return single.unionByName(mixed)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k1, k2, the spans of each text that has any (what its repeats cover), and the number of its repeats."""
    every = occurrences(docs, length, gram, listed=False).distinct()
    return every.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))).alias("spans"), F.countDistinct("repeat").alias("repeats"))


def _with_spans(docs: DataFrame, columns: list[Column], length: int, gram: int) -> DataFrame:
    covered = staged(spans(docs, length, gram), "spans")
    text = text_or_empty()
    keyed = docs.select(*columns, *_key(text), text.alias("_text"))
    return keyed.join(covered, ["k1", "k2"], "left").drop("k1", "k2")


def _kept(text: str, own: list[dict] | None) -> tuple[bytes, list[bytes], list[tuple[int, int]]]:
    """The text's bytes, what is left of them, and the removed spans."""
    data = text.encode()
    gone = merged([(s["begin"], s["end"]) for s in own or ()])
    at, left = 0, []
    for a, b in gone:
        left.append(data[at:a])
        at = b
    return data, [*left, data[at:]], gone


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with every repeat cut out of its texts."""
    row = docs.select(whole_row(docs), "doc_id", "text")
    joined = _with_spans(row, [F.col("_row")], length, gram)

    @F.udf(returnType="string", useArrow=True)
    def cut(text: str, own: list) -> str:
        return b"".join(p.decode("utf-8", "ignore").encode() for p in _kept(text, own)[1]).decode()

    clean = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(cut("_text", "spans"))
    return joined.select(*own_columns(docs.columns, text=clean))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _with_spans(documents(spark, sf_dir), [F.col("doc_id").cast("long").alias("doc_id")], LENGTH, GRAM)

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, own, repeats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_text", "spans", "repeats")), strict=True):
            data, left, gone = _kept(text, own)
            rows.append((doc, len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(left)).hexdigest(), repeats or 0))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeats"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_arrow(joined, of_batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeats long")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without their repeats."""
    return deduplicate(docs)
