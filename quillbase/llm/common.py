"""Shared plumbing: scratch tables, hashing, cached tokenisation, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import threading
import time
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)  # splitmix64's published multipliers
GOLDEN = U64(0x9E3779B97F4A7C15)

#: Entries after which a worker's word cache is dropped; bounds its memory, never its results.
CACHE_ENTRIES = 1_500_000
#: Seconds that a stage takes before the driver collects its garbage; shorter ones leave little behind.
COLLECT_S = 0.7
#: Seconds without use after which a worker drops its caches, so that an idle one leaves its memory to the executor.
IDLE_S = 3


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; a local session may do without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quillbase-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path, began = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", time.monotonic()
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    if time.monotonic() - began > COLLECT_S:
        gc.collect()  # lets Spark drop the shuffle files of the plan that ended
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


def whole_row(docs: DataFrame) -> Column:
    """All of a frame's columns as one struct `_row`, so that no name of the caller's meets one of an operator's."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_columns(columns: Sequence[str], **changed: Column) -> list[Column]:
    """The caller's columns out of `_row`, some of them anew."""
    return [(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in columns]


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * M1
    x = (x ^ (x >> U64(27))) * M2
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and its n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Idle:
    """Clears the caches of a worker that has been idle; hold it while using one."""

    def __init__(self) -> None:
        self.lock, self.used, self.caches, self.process = threading.Lock(), 0.0, [], 0

    def __enter__(self) -> None:
        self.lock.acquire()
        if self.process != os.getpid():
            self.process = os.getpid()
            threading.Thread(target=self._watch, daemon=True).start()

    def __exit__(self, *_: object) -> None:
        self.used = time.monotonic()
        self.lock.release()

    def _watch(self) -> None:
        while True:
            time.sleep(1)
            if any(self.caches) and time.monotonic() - self.used > IDLE_S and self.lock.acquire(blocking=False):
                for c in self.caches:
                    c.clear()
                self.lock.release()
                gc.collect()
                give_back()


idle = _Idle()


def kept(cache: dict) -> dict:
    """A cache that goes when its worker is idle."""
    idle.caches.append(cache)
    return cache


class WordIds(dict):
    """Word -> a fixed 64-bit hash, kept for words met before."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES // 2:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def hashes(self, words: list[str]) -> np.ndarray:
        with idle:
            return np.fromiter(map(self.__getitem__, words), U64, len(words))


#: Kinds of bytes.
_SEPARATOR, _LETTER, _MARK = 1, 2, 3


class PieceCache:
    """Ids of whole texts from the ids of their space-delimited pieces, which are kept between texts.

    With `joined`, a piece carries the one space or line feed before it, and a text with a piece whose ids depend on its
    neighbours is encoded in one go; without, white space is dropped and any split will do. Pieces are cut and numbered
    by numpy and Arrow; only distinct ones that are not known become Python strings with work of their own.
    """

    #: Marks before which a letter's token ends, so that a piece may begin there.
    MARKS = ""

    def __init__(self, joined: bool, entries: int):
        self.joined, self.entries = joined, entries
        #: Two generations: what was used since the younger one began, and what was known before.
        self.cache: dict[str, bytes] = kept({})
        self.old: dict[str, bytes] = kept({})
        #: Strings whose texts are encoded in one go.
        self.openings: list[str] = []
        self.kind = np.zeros(256, np.uint8)
        self.kind[[10, 32]] = _SEPARATOR
        self.kind[[*range(65, 91), *range(97, 123)]] = _LETTER
        self.kind[list(self.MARKS.encode())] = _MARK

    def _encode(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self._encode(texts)

    def _bound(self, piece: str) -> bool:
        """Whether the ids of a piece may depend on its neighbours."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a string column without nulls."""
        with idle:
            return self._from_cache(texts)

    def _fill(self, words: list[str], ids: list[bytes | None], missing: list[int]) -> list[int]:
        """Ids of pieces that the cache lacks; gives those that depend on their neighbours, which get none."""
        cache, old, bound_ = self.cache, self.old, self._bound
        if len(cache) + len(missing) > self.entries // 2:  # a new generation begins with this block
            old.clear()
            old.update(cache)
            cache.clear()
        bound = []
        if self.joined:
            bound = [i for i in missing if not (words[i][0] in " \n" and words[i][1:].isalpha()) and bound_(words[i])]
            for i in bound:
                ids[i] = b""
        if old:
            for i in missing:
                if ids[i] is None and (b := old.pop(words[i], None)) is not None:
                    ids[i] = cache[words[i]] = b
        ask = [i for i in missing if ids[i] is None]
        for at in range(0, len(ask), 20_000):
            some = ask[at : at + 20_000]
            asked = [words[i] for i in some]
            found = self._encode(asked)
            cache.update(zip(asked, found, strict=True))
            for i, b in zip(some, found, strict=True):
                ids[i] = b
        return bound

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts' pieces one after another, and where each text's begin."""
        data, offsets = text_bytes(texts)
        kind, n = self.kind[data], len(data)
        separator = kind == _SEPARATOR
        start = separator.copy()
        start[offsets[offsets < n]] = True
        if self.MARKS:
            at = np.flatnonzero(kind == _MARK)
            at = at[~start[at]]
            # Latin-1's letters from U+00C0 on are the byte C3 and another, but for the signs at 97 and B7
            latin = (data[at - 2] == 0xC3) & (data[at - 1] >= 0x80) & (data[at - 1] != 0x97) & (data[at - 1] != 0xB7)
            start[at[(kind[at - 1] == _LETTER) | latin]] = True
        begin = np.flatnonzero(start)
        bounds = np.searchsorted(begin, offsets)
        if not self.joined:
            gone = separator[begin]
            begin -= np.cumsum(gone) - gone
            data = data[~separator]
        ends = np.append(begin, len(data))
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))), bounds

    def _from_cache(self, texts: pa.Array) -> list[bytes]:
        import pyarrow.compute as pc

        pieces, bounds = self._pieces(texts)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = list(map(self.cache.get, words))
        missing = [i for i, b in enumerate(ids) if b is None]
        whole = np.zeros(len(texts), bool)
        for s in self.openings:
            whole |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        if missing and (bound := self._fill(words, ids, missing)):
            alone = np.zeros(len(words), bool)
            alone[bound] = True
            at = np.flatnonzero(alone[coded.indices.to_numpy()])
            whole[np.searchsorted(bounds, at, "right") - 1] = True
        tokens = pa.array(ids, pa.large_binary()).take(coded.indices)
        cut = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1)[bounds].tolist() if len(tokens) else [0] * (len(texts) + 1)
        flat = memoryview(tokens.buffers()[2] or b"")
        out = [bytes(flat[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if rows := np.flatnonzero(whole).tolist():
            for i, b in zip(rows, self._whole(texts.take(pa.array(rows)).to_pylist()), strict=True):
                out[i] = b
        return out


def _cut(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian 32-bit ids."""
    flat = array("I", chain.from_iterable(ids)).tobytes()
    ends = [4 * n for n in accumulate(map(len, ids))]
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_encoders: dict[tuple[str, bool, bool], CachedEncoder] = {}


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's spelling of bytes: printable Latin-1 as itself, the others as U+0100 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_BYTE_ALPHABET = _byte_alphabet()


class CachedEncoder(PieceCache):
    """The tokenizers library's ids. Both vocabularies split at spaces and line feeds before anything else.

    Strings of special tokens are ordinary text, or with `special` those tokens; texts that may hold one are then encoded in one go.
    """

    #: Not ' as of contractions, nor < | > as of the strings that the word vocabulary's pattern names.
    MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
    PROBES = ("a", "The", " the", " Word", "naïve", " Größe", " ÉCOLE", "œuvre", " ñandú", "verständigung", " supercalifragilistic")

    def __init__(self, path: str, joined: bool, entries: int = CACHE_ENTRIES, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__(joined, entries)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.openings = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}) if special else []
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.line = self._by_tokenizer(["\n"])[0]
        # a word of letters is one pre-token; whether its model ids are the tokenizer's is tried out once
        self.direct = all(self._letters(w) is None or self._of_model([self._letters(w)]) == self._by_tokenizer([w]) for w in self.PROBES)

    def _by_tokenizer(self, pieces: list[str]) -> list[bytes]:
        return _cut([e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])

    def _of_model(self, spelled: list[str]) -> list[bytes]:
        return _cut([[t.id for t in tokens] for tokens in map(self.model.tokenize, spelled)])

    def _letters(self, piece: str) -> str | None:
        """A word of Latin letters as the model spells it: normalised, in the byte alphabet; None for other pieces."""
        word = piece[1:] if self.joined and piece[:1] == " " else piece
        if not word.isalpha():
            return None
        if not self.joined:
            piece = piece if piece.isascii() or is_normalized("NFC", piece) else ""
            piece = piece.lower()
            if not piece.isalpha():
                return None
        if piece.isascii():
            return piece.replace(" ", _BYTE_ALPHABET[32])
        return piece.encode().decode("latin-1").translate(_BYTE_ALPHABET) if max(piece) < "\u0250" else None

    def _encode(self, pieces: list[str]) -> list[bytes]:
        if not self.direct:
            return self._by_tokenizer(pieces)
        letters, line = self._letters, {}
        if self.joined:
            space = _BYTE_ALPHABET[32]
            spelled = [space + w[1:] if w[0] == " " and w.isascii() and w[1:].isalpha() else letters(w) for w in pieces]
            # a line feed before a letter is a token of its own
            line = {i: s for i, w in enumerate(pieces) if spelled[i] is None and w[0] == "\n" and (s := letters(w[1:])) is not None}
        else:
            spelled = [w if w.isascii() and w.islower() and w.isalpha() else letters(w) for w in pieces]
        out: list[bytes | None] = [None] * len(pieces)
        other = [i for i, s in enumerate(spelled) if s is None and i not in line]
        for i, b in zip(other, self._by_tokenizer([pieces[i] for i in other]), strict=True):
            out[i] = b
        for i, b in zip(line, self._of_model(list(line.values())), strict=True):
            out[i] = self.line + b
        direct = [i for i, s in enumerate(spelled) if s is not None]
        for i, b in zip(direct, self._of_model([spelled[i] for i in direct]), strict=True):
            out[i] = b
        return out  # type: ignore[return-value]

    def _bound(self, piece: str) -> bool:
        return not piece or piece[-1].isspace() or piece[1:2].isspace()


def encoder(path: str, joined: bool, entries: int = CACHE_ENTRIES, special: bool = False) -> CachedEncoder:
    """One encoder for each Python worker."""
    key = (path, joined, special)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, joined, entries, special)
    return _encoders[key]


def give_back() -> None:
    """Return freed memory to the system, so that a worker's peak doesn't stay with its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)


def runs(parts: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Consecutive (begin, end) whose summed parts stay near `size`."""
    begin = total = 0
    for i, n in enumerate(parts):
        if total and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(parts):
        yield begin, len(parts)


def text_blocks(column: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a string column, in blocks of about `size` bytes; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    for i, j in runs(np.diff(offsets).tolist(), size):
        yield i, column.slice(i, j - i)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
