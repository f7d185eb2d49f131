"""Token-ID output: shards of ids under Re-Pair grammar compression, with random access.

Documents are dealt by ranges of doc_id, encoded, and cut into shards of about SHARD ids. Within a shard Re-Pair replaces
adjacent pairs that occur LEAST times or more by nonterminals until none is left or 16 bits name no more. It works in
rounds: a round counts all pairs, and where frequent pairs overlap the more frequent one wins, so the most frequent pair
of a round is always replaced; what it leaves and what its nonterminals form is counted again in the next round. Pairs
never cross a document's end id, so a document starts at a symbol. A shard's record is a binary file body: header, rules,
expansion lengths, the documents' first symbols, symbols. Memory is bounded by the shard. Spark writes the records into
Parquet files, so any store that Spark can reach will do, and a lost task leaves nothing behind.

The strings of the vocabulary's special tokens are ordinary text, as the vocabularies' own notes set it
(encode_special_tokens); `special=True` gives their ids instead, which is what the library does when nothing is set.

Defined cases: a null text is empty and holds the end id alone; null ids come first; repeated ids and rows stay apart, in
order of their place in the input, and are dealt to several tasks if they are many; very long texts make a larger shard;
other columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import documents, encoder, give_back, staged, text_blocks, text_or_empty, vocabulary, width

END = 2
#: First nonterminal.
TERMINALS = 50257
SHARD = 1 << 18
#: Occurrences that a pair needs.
LEAST = 16
MAGIC = b"QRPR1\0\0\0"
FILES = "part int, shard int, before long, n_ids long, docs array<long>, body binary"
BLOCK = 8 << 20
#: Pieces a worker keeps; it compresses besides.
ENTRIES = 1_400_000
#: Bits, at most, of the hash by which pairs are counted.
_BITS = 18
#: The bits of a symbol, and the one beside them that marks a place to look at.
SYMBOL, OPEN = np.uint32(65535), np.uint32(1 << 16)
#: Longest expansion that is looked up whole when symbols are expanded.
SHORT = 512


def _frequent(symbols: np.ndarray, at: np.ndarray, end: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places `at` those whose pair may occur `least` times or more, overlaps counted, and the pairs there."""
    key = symbols.take(at)
    key <<= np.uint32(16)
    key |= symbols[1:].take(at) & SYMBOL
    bits = min(_BITS, max(8, len(at).bit_length()))
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.intp)
    some = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= least).take(bucket))
    at, key = at.take(some), key.take(some)
    inside = np.flatnonzero((key >> np.uint32(16) != end) & (key & SYMBOL != end))
    return at.take(inside), key.take(inside)


def _winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places are replaced: those whose pair ranks before the pairs that overlap it; of equal ones every other, from the left."""
    first = np.r_[True, (np.diff(at) > 1) | (rank[1:] != rank[:-1])]
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    order = 2 * rank + (nth & 1)
    beside = np.diff(at) == 1
    lower = order[1:] < order[:-1]
    return np.r_[True, ~beside | lower] & np.r_[~beside | ~lower, True]


def repair(ids: np.ndarray, end: int = END, terminals: int = TERMINALS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[i] is the pair that nonterminal terminals + i stands for.

    A pair of symbols that are there already only gets rarer, so after the first round places are looked at whose pair was
    frequent in the last one or has one of its nonterminals.
    """
    # a symbol's place is open where OPEN is set beside it
    symbols, rules, made = ids.astype(np.uint32) | OPEN, [], terminals
    while len(symbols) > 1 and made < 65536:
        at, key = _frequent(symbols, np.flatnonzero(symbols[:-1] >= OPEN), end, least)
        order = np.argsort(key)
        ordered = key[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(at)])
        best = np.flatnonzero(sizes >= least)
        if not len(best):
            break
        best = best[np.argsort(-sizes[best], kind="stable")]
        rank = np.full(len(starts), -1, np.int32)
        rank[best] = np.arange(len(best), dtype=np.int32)
        of = np.empty(len(at), np.int32)
        of[order] = np.repeat(rank, sizes)
        often = np.flatnonzero(of >= 0)
        at, of = at[often], of[often]
        symbols &= SYMBOL
        symbols[at] |= OPEN
        won = np.flatnonzero(_winners(at, of))
        at, of = at[won], of[won]
        # a rule takes as much room as four symbols: pairs that overlaps leave few of wait for a later round, but for the first
        used = np.bincount(of, minlength=len(best)) >= least // 2
        used[0] = True
        used[np.flatnonzero(used)[65536 - made :]] = False
        name = (np.cumsum(used) - 1 + made).astype(np.uint32)
        kept = np.flatnonzero(used[of])
        at, of = at[kept], of[kept]
        pairs = ordered[starts[best[used]]]
        rules.append(np.stack([pairs >> np.uint32(16), pairs & SYMBOL], 1).astype(np.uint16))
        symbols[at] = name[of] | OPEN
        symbols[np.maximum(at - 1, 0)] |= OPEN
        symbols = np.delete(symbols, at + 1)
        made += len(pairs)
    return symbols.astype(np.uint16), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def expansion_lengths(rules: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule only names earlier ones."""
    lengths = np.zeros(len(rules), np.int64)
    left, right = rules[:, 0].astype(np.int64) - terminals, rules[:, 1].astype(np.int64) - terminals
    while (lengths == 0).any():
        known = lambda s: np.where(s < 0, 1, lengths[np.maximum(s, 0)])
        a, b = known(left), known(right)
        lengths = np.where((a > 0) & (b > 0), a + b, 0)
    return lengths


class Shard:
    """A record's body, read in place."""

    def __init__(self, body: bytes):
        magic, terminals, n_rules, n_docs, n_symbols = struct.unpack_from("<8sIIIQ", body)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.terminals, at = terminals, struct.calcsize("<8sIIIQ")
        self.rules = np.frombuffer(body, "<u2", 2 * n_rules, at).reshape(-1, 2)
        at += 4 * n_rules
        self.lengths = np.frombuffer(body, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.first = np.frombuffer(body, "<u4", n_docs + 1, at)
        self.symbols = np.frombuffer(body, "<u2", n_symbols, at + 4 * (n_docs + 1))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of up to SHORT ids one after another, and the byte where each symbol's begins; longer ones are left out."""
        if self._table is None:
            short = self.lengths <= SHORT
            sizes = np.concatenate([np.ones(self.terminals, np.int32), np.where(short, self.lengths, 0).astype(np.int32)])
            begin = 4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
            made = self._halved(self.rules[short].reshape(-1), 1)
            self._table = (np.concatenate([np.arange(self.terminals, dtype="<u4"), made.astype("<u4")]), begin)
        return self._table

    def _halved(self, symbols: np.ndarray, most: int) -> np.ndarray:
        """Symbols of expansions of over `most` ids replaced by their pairs, again and again."""
        made = symbols.astype(np.int32)
        lengths = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        while len(rule := np.flatnonzero(lengths[made] > most)):
            size = np.ones(len(made), np.int32)
            size[rule] = 2
            first = (np.cumsum(size) - size)[rule]
            pair = self.rules[made[rule] - self.terminals]
            made = np.repeat(made, size)
            made[first], made[first + 1] = pair[:, 0], pair[:, 1]
        return made

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        if len(self.lengths) and self.lengths.max() > SHORT:
            symbols = self._halved(symbols, SHORT)
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(flat)])
        made = table.take(pa.array(symbols)).buffers()[2]
        return np.frombuffer(made, "<u4") if made is not None and len(symbols) else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document alone."""
        return self.expand(self.symbols[self.first[i] : self.first[i + 1]])

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The shard's ids from begin to end, expanding only symbols that reach into them."""
        size = np.where(self.symbols < self.terminals, 1, self.lengths[np.maximum(self.symbols.astype(np.int64) - self.terminals, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        i, j = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skip = begin - (int(ends[i - 1]) if i else 0)
        return self.expand(self.symbols[i:j])[skip : skip + max(0, end - begin)]

    def sizes(self) -> np.ndarray:
        """Ids of each document, from expansion lengths alone."""
        size = np.ones(len(self.symbols), np.int64)
        rule = np.flatnonzero(self.symbols >= self.terminals)
        size[rule] = self.lengths[self.symbols[rule].astype(np.int64) - self.terminals]
        total = np.concatenate([[0], np.cumsum(size)])
        return np.diff(total[self.first])


def body(documents_: list[bytes], end: int = END, terminals: int = TERMINALS) -> bytes:
    """A record's body from the documents' little-endian 32-bit ids, each with its end id."""
    ids = np.frombuffer(b"".join(documents_), "<u4")
    if len(ids) and ids.max() >= terminals:
        raise ValueError("an id is outside the vocabulary")
    symbols, rules = repair(ids, end, terminals)
    lengths = expansion_lengths(rules, terminals)
    size = np.ones(len(symbols), np.int64)
    rule = np.flatnonzero(symbols >= terminals)
    size[rule] = lengths[symbols[rule].astype(np.int64) - terminals]
    bounds = np.concatenate([[0], np.cumsum([len(d) // 4 for d in documents_])])
    first = np.searchsorted(np.concatenate([[0], np.cumsum(size)]), bounds)
    head = struct.pack("<8sIIIQ", MAGIC, terminals, len(rules), len(documents_), len(symbols))
    return b"".join([head, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), first.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()])


def encode(docs: DataFrame, vocabulary_file: str, end: int = END, special: bool = False) -> DataFrame:
    """Records of FILES; partitions and shards are in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(vocabulary_file, True, ENTRIES, special), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        held: list[bytes] = []
        ids: list[int] = []
        n = before = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, n, before, shard
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            row = (part, shard, before, n, ids, body(held, end))
            held, ids, before, shard, n = [], [], before + n, shard + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in FILES.split(", ")])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for i, texts in text_blocks(batch.column("text"), BLOCK):
                for doc, whole in zip(keys[i:], tokens.encode(texts), strict=False):
                    held.append(whole + last)
                    ids.append(doc)
                    n += len(whole) // 4 + 1
                    if n >= SHARD:
                        yield flush()
        if held:
            yield flush()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(width(docs.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", "place")
    return ordered.mapInArrow(run, FILES)


def index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the records."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each partition
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    base = dict(zip([r["part"] for r in totals], starts, strict=False))
    shared = files.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "docs", "body")), strict=True):
                shard = Shard(data)
                ids, sizes = memoryview(shard.expand(shard.symbols)).cast("B"), shard.sizes()
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                start = shared.value[part] + before + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(staged(encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")), "ids"))
