"""Media columns: content-defined chunking, deduplicated chunks and verified reconstruction.

A payload is cut where a rolling gear hash of its last 32 bytes has a number of leading zeros, between a least and a most
number of bytes after the last cut; texts are cut by TEXT, well under the length of a typical text. Tasks write what they
cut as packs, with no shuffle: one row for each payload, its bytes and the digests and sizes of its chunks, the first time
a batch meets it. Of all rows of a payload one is its reader, and of all places of a digest among readers one is canonical,
by aggregations and joins over digests alone. A payload is read back through its ordered chunk list, each chunk from its
canonical place: if all are its own they are read where they lie; others are fetched by joins over digests and come
together by payload, in order.

Which rows ask for chunks of others, and which hold such chunks, is told by two bit filters over their places, broadcasts
of BITS / 8 bytes at any size of the corpus: a row that a filter names by chance takes the join too, to the same result.
A third one, over the digests that have several places, keeps chunks of one place out of the join that finds requests.

A payload's stored form is its chunk list file (magic, count, and for each chunk its SHA-256 and length) followed by its
chunks' 8-bit samples in order. `media_bytes` is its length and `media_sha256` its digest, both taken as it is read back.
A payload that does not hash to the key under which it was stored raises an error, as does a chunk that is missing.

Defined cases: null and empty texts have a payload of 576 bytes 255; rows are keyed by payload, not by id, so repeated
rows, repeated ids and equal texts get equal values, one row for each input row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import GOLDEN, U64, documents, map_arrow, mix, runs, staged, text_bytes, width

UNIT = 576
#: Sizes that `cuts` takes unless told others: chunks of about 34 KB.
LEAST, MOST, CUT_BITS = 2048, 131072, 15
#: Least, most and leading zeros by which texts are cut: chunks of about 1.3 KB.
TEXT = (256, 8192, 10)
MAGIC = b"QCDC2\0\0\0"
#: Bytes hashed at once within a batch.
BLOCK = 4 << 20
#: Bits of the filter over places, and bits that a place sets.
BITS, HASHES = 1 << 25, 4

PACK = "doc_id long, payload binary, n_bytes long, digests array<binary>, sizes array<int>, data binary"
READ = "payload binary, payload_bytes long, tail_crc32 long, media_bytes long, media binary, feature string"
_HELD = ("place", "payload", "digests", "sizes", "data")
_HELD_TYPES = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
_NAMES = tuple(c.split()[0] for c in READ.split(", "))
_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum over the last 32 bytes of table[byte] << age, by doubling."""
    table = (mix(np.arange(1, 257, dtype=U64) * GOLDEN) >> U64(32)).astype(np.uint32)
    h = table[data]
    for age in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[age:] = h[:-age]
        h = h + (older << np.uint32(age))
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = CUT_BITS) -> list[list[int]]:
    """Ends of the chunks of data[offsets[i]:offsets[i + 1]], for each i; bytes before a payload never matter, as least > 32."""
    places = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], begin
        while end - at > least:
            k = np.searchsorted(places, at + least)
            cut = min(int(places[k]) if k < len(places) else end, at + most, end)
            ends.append(cut)
            at = cut
        if at < end:
            ends.append(end)
        out.append(ends)
    return out


def payloads(column: pa.Array) -> tuple[list[bytes], list[int]]:
    data, offsets = text_bytes(column)
    raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [t + b"\xff" * (-len(t) % UNIT if t else UNIT) for t in raw], [len(t) for t in raw]


def pack(docs: DataFrame) -> DataFrame:
    """One row for each document; chunks and bytes of its payload the first time a batch meets it. `place` numbers the rows."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, lengths = payloads(batch.column("text"))
        seen: set[bytes] = set()
        rows: list[tuple] = []
        for i, j in runs([len(p) for p in whole], BLOCK):
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in whole[i:j]])])
            for k, ends in enumerate(cuts(np.frombuffer(b"".join(whole[i:j]), np.uint8), offsets, *TEXT), i):
                key = hashlib.sha256(whole[k]).digest()
                if key in seen:
                    rows.append((key, lengths[k], None, None, None))
                    continue
                seen.add(key)
                bounds = [0, *[e - int(offsets[k - i]) for e in ends]]
                digests = [key] if len(ends) == 1 else [hashlib.sha256(whole[k][a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:])]
                rows.append((key, lengths[k], digests, [b - a for a, b in zip(bounds[:-1], bounds[1:])], whole[k]))
        types = (pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
        names = [c.split()[0] for c in PACK.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return map_arrow(docs.select("doc_id", "text"), of_batch, PACK).withColumn("place", F.monotonically_increasing_id())


def feature(histogram: np.ndarray) -> str:
    n = histogram.sum()
    p = histogram[histogram > 0] / n
    mean = float((histogram * np.arange(256)).sum() / n)
    spread = float(np.sqrt((histogram * (np.arange(256) - mean) ** 2).sum() / n))
    return f"samples={n};mean={mean:.4f};deviation={spread:.4f};entropy={-float((p * np.log2(p)).sum()):.4f}"


def listing(digests: Sequence[bytes], sizes: Sequence[int]) -> bytes:
    """The chunk list file."""
    return MAGIC + struct.pack(">I", len(digests)) + b"".join(d + struct.pack(">I", n) for d, n in zip(digests, sizes, strict=True))


def _row(key: bytes, digests: Sequence[bytes], sizes: Sequence[int], chunks: Iterator[bytes]) -> tuple:
    """A row of READ from a payload's chunk list and its chunks in order, which are hashed as they come."""
    head = listing(digests, sizes)
    own, media, n, tail, histogram = hashlib.sha256(), hashlib.sha256(head), 0, b"", np.zeros(256, np.int64)
    for chunk in chunks:
        n += len(chunk)
        own.update(chunk)
        media.update(chunk)
        tail = (tail + chunk)[-32:]
        histogram += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
    if own.digest() != key:
        raise ValueError(f"stored payload {key.hex()} reads back as {own.hexdigest()}")
    return own.digest(), n, zlib.crc32(tail), len(head) + n, media.digest(), feature(histogram)


def _columns(rows: list[tuple], types: Sequence[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]


def _reads(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_columns(rows, _TYPES), names=list(_NAMES))


# -- which chunk is read where


def _held(packs: DataFrame) -> DataFrame:
    return packs.where(F.col("data").isNotNull())


def readers(packs: DataFrame) -> DataFrame:
    """payload -> the place of the one row that it is read from."""
    return _held(packs).groupBy("payload").agg(F.min("place").alias("place"))


def chunks(packs: DataFrame, readers_: DataFrame) -> DataFrame:
    """(place, seq, digest) of all chunks of the readers."""
    return _held(packs).select("place", "digests").join(readers_.select("place"), "place").select("place", F.posexplode("digests").alias("seq", "digest"))


def canonical(chunks_: DataFrame) -> DataFrame:
    """digest -> its canonical (place, seq), and the number of its places."""
    return chunks_.groupBy("digest").agg(F.min(F.struct("place", "seq")).alias("best"), F.count("*").alias("n"))


def requests(chunks_: DataFrame, bits: int = BITS) -> DataFrame:
    """(place, seq, digest, holder, holder_seq) of the chunks whose canonical place is another one."""
    shared = staged(canonical(chunks_).where("n > 1"), "shared")
    both = maybe_shared(chunks_, shared, bits).join(shared, "digest").where((F.col("place") != F.col("best.place")) | (F.col("seq") != F.col("best.seq")))
    return both.select("place", "seq", "digest", F.col("best.place").alias("holder"), F.col("best.seq").alias("holder_seq"))


def maybe_shared(chunks_: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """The rows of `chunks_` whose digest is in `shared`, and a few others, so that the join need not move all chunks."""
    of_digest = F.xxhash64("digest")
    known = chunks_.sparkSession.sparkContext.broadcast(bit_filter(shared.select(of_digest), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = batch.filter(pa.array(_named(known.value, batch.column("hash").to_numpy())))
                yield kept.select(["place", "seq", "digest"])

    return chunks_.select("place", "seq", "digest", of_digest.alias("hash")).mapInArrow(run, "place long, seq int, digest binary")


def _positions(places: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bits of the filter for each place; `bits` is a power of 2."""
    h = mix(places.astype(U64) + GOLDEN)
    return np.stack([(mix(h + np.array(k, U64)) & U64(bits - 1)).astype(np.int64) for k in range(HASHES)])


def bit_filter(places: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter over places, or over hashes, as 32-bit words. Bits are joined before they reach the driver: bits / 32 rows at most."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(_positions(batch.column(0).to_numpy(), bits))
        first = np.flatnonzero(np.r_[True, np.diff(at >> 5) > 0])
        return pa.RecordBatch.from_arrays([pa.array(at[first] >> 5), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 31), first))], names=["word", "bits"])

    words = map_arrow(places, of_batch, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _named(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = _positions(places, 32 * len(words))
    return (words[at >> 5] >> (at & 31).astype(np.uint32) & 1).all(0)


# -- reading


def _read_own(packs: DataFrame, asks: np.ndarray, holds: np.ndarray) -> DataFrame:
    """READ of the rows that do not ask for chunks of others (columns read_*), and as they are those that ask or hold."""
    shared = packs.sparkSession.sparkContext.broadcast((asks, holds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asking, holding = (_named(words, batch.column("place").to_numpy()) for words in shared.value)
            other = batch.filter(pa.array(asking | holding))
            rows = []
            for key, digests, sizes, data in zip(*(batch.filter(pa.array(~asking)).column(c).to_pylist() for c in _HELD[1:]), strict=True):
                ends = np.cumsum(sizes).tolist()
                rows.append(_row(key, digests, sizes, (data[e - n : e] for e, n in zip(ends, sizes, strict=True))))
            both = lambda first, then: pa.chunked_array([first, then]).combine_chunks()
            done = [both(r, pa.nulls(other.num_rows, t)) for r, t in zip(_columns(rows, _TYPES), _TYPES, strict=True)]
            left = [both(pa.nulls(len(rows), t), other.column(c).cast(t)) for c, t in zip(_HELD, _HELD_TYPES, strict=True)]
            some = [both(pa.nulls(len(rows), pa.bool_()), pa.array(x[asking | holding])) for x in (asking, holding)]
            yield pa.RecordBatch.from_arrays([*left, *some, *done], names=[*_HELD, "asks", "holds", *(f"read_{c}" for c in _NAMES)])

    kinds = "place long, payload binary, digests array<binary>, sizes array<int>, data binary, asks boolean, holds boolean, " + ", ".join(f"read_{c}" for c in READ.split(", "))
    return _held(packs).select(*_HELD).mapInArrow(run, kinds)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (digests, sizes, data, wanted) -> (digest, chunk) of the wanted ones."""
    out = []
    for digests, sizes, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("digests", "sizes", "data", "wanted")), strict=True):
        ends = np.cumsum(sizes).tolist()
        out += [(digests[k], data[ends[k] - sizes[k] : ends[k]]) for k in wanted]
    return pa.RecordBatch.from_arrays(_columns(out, (pa.binary(), pa.binary())), names=["digest", "chunk"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (place, seq): a payload's own row under seq -1, then the chunks fetched for it -> READ."""

    def done(own: tuple, fetched: dict[int, bytes]) -> tuple:
        _, key, digests, sizes, data = own
        ends = np.cumsum(sizes).tolist()
        return _row(key, digests, sizes, (fetched.get(k, data[e - n : e]) for k, (e, n) in enumerate(zip(ends, sizes, strict=True))))

    own, fetched = None, {}
    for batch in batches:
        out = []
        for *row, seq, chunk in zip(*(batch.column(c).to_pylist() for c in (*_HELD, "seq", "chunk")), strict=True):
            if seq < 0:
                out += [done(own, fetched)] if own else []
                own, fetched = tuple(row), {}
            elif own is None or own[0] != row[0] or chunk is None:
                raise ValueError("a chunk is missing")
            else:
                fetched[seq] = chunk
        if out:
            yield _reads(out)
    if own:
        yield _reads([done(own, fetched)])


def reconstruct(packs: DataFrame, bits: int = BITS) -> DataFrame:
    """READ for each payload, from canonical chunks in the order of its list."""
    n = width(packs.sparkSession)
    read_from = readers(packs)
    wanted = staged(requests(staged(chunks(packs, read_from), "chunks"), bits), "requests")
    asks, holds = (bit_filter(wanted.select(c), bits) for c in ("place", "holder"))
    both = staged(_read_own(packs, asks, holds), "read", compression="zstd")
    alone = both.where("place IS NULL").select(*[F.col(f"read_{c}").alias(c) for c in _NAMES])

    sought = wanted.select(F.col("holder").alias("place"), "holder_seq").distinct().groupBy("place").agg(F.collect_list("holder_seq").alias("wanted"))
    held = both.where("holds").select(*_HELD).join(sought, "place").select("digests", "sizes", "data", "wanted")
    bytes_ = staged(map_arrow(held, _cut, "digest binary, chunk binary"), "fetched", compression="zstd")
    fetched = wanted.select("place", "seq", "digest").join(bytes_, "digest", "left").select("place", "seq", "chunk")
    own = both.where("asks").select(*_HELD, F.lit(-1).alias("seq"), F.lit(None).cast("binary").alias("chunk"))
    rows = own.unionByName(fetched, allowMissingColumns=True).repartition(n, "place").sortWithinPartitions("place", "seq")
    reads = alone.unionByName(rows.select(*_HELD, "seq", "chunk").mapInArrow(_assemble, READ))
    return reads.dropDuplicates(["payload"])  # a batch reads its own row of a payload, even if another one is the reader


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = staged(pack(documents(spark, sf_dir)), "packs", compression="zstd")
    both = packs.select("doc_id", "payload", "n_bytes").join(reconstruct(packs), "payload", "left")
    both = both.withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.lit("a payload is missing")).cast("long")))
    hexed = lambda c: F.lower(F.hex(c))
    return both.select("doc_id", "n_bytes", "payload_bytes", hexed("payload").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("media").alias("media_sha256"), "feature")
