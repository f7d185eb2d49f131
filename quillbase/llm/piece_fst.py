"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file. The normaliser is sequential: a trie of the model's character map, read
by longest match, then white space (dummy prefix, folding, U+2581 for spaces), whose state is whether a space came last;
composing an input with it leaves one path, which is followed as it is read. The pieces' transducer is a trie whose states
remember the piece read last. Byte fallback has an arc for each character that no piece spells. For a unigram model an arc
weighs minus the piece's score. For a BPE model an arc from piece a to piece b weighs 0 if merging the characters of ab by
rank gives back a, b, and infinity otherwise: a segmentation is what BPE's merges produce just if all its neighbours are
so, hence the path of finite weight is BPE's result. Byte arcs weigh 1 each. The normalised path is composed with the union
of pieces and fallback lazily, and the shortest path of the tropical semiring is taken, position by position.

No piece spans a word boundary (checked when the model is read), so words are composed one at a time and their paths
kept for words met before; the cache is bounded.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become their UTF-8 bytes' pieces, or
the unknown id where the model has no byte pieces; a literal U+2581 decodes to a space, as in the sentencepiece library;
repeated rows get equal ids; very long texts are taken whole, word by word; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillbase.llm.common import CACHE_ENTRIES, PieceCache, documents, kept, map_arrow, text_blocks, text_or_empty, vocabulary

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, DEFINED, BYTE = 1, 2, 3, 4, 6
INFINITE = float("inf")
#: Bytes of text encoded at once.
BLOCK = 8 << 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def character_map(blob: bytes) -> dict[str, str]:
    """A model's compiled character map (a double-array trie of 32-bit units, then the strings it points to) as source -> target."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    labels, out, todo = np.arange(1, 256), {}, [(0, b"")]
    while todo:
        at, source = todo.pop()
        unit = int(units[at])
        if source and unit >> 8 & 1:
            begin = int(units[at ^ offset(unit)]) & 0x7FFFFFFF
            out[source.decode()] = strings[begin : strings.index(b"\0", begin)].decode()
        next_ = at ^ offset(unit) ^ labels
        next_, own = next_[next_ < len(units)], labels[next_ < len(units)]
        hit = units[next_] & 0x800000FF == own
        todo += [(n, source + bytes([c])) for n, c in zip(next_[hit].tolist(), own[hit].tolist(), strict=True)]
    return out


class Normaliser:
    """A sequential transducer: the character map's trie, then white space."""

    def __init__(self, mapping: dict[str, str], prefix: bool, fold: bool):
        self.mapping, self.prefix, self.fold = mapping, prefix, fold
        self.starts = {k[0] for k in mapping}
        self.prefixes = {k[:n] for k in mapping for n in range(1, len(k) + 1)}

    @property
    def plain(self) -> bool:
        """Whether spaces are all that changes."""
        return not self.mapping and not self.fold

    def _read(self, text: str, at: int) -> tuple[str, int]:
        """Output of the longest match at a place, or the character itself; and where it ends."""
        best, end = text[at], at + 1
        if best in self.starts:
            n = at + 1
            while n <= len(text) and text[at:n] in self.prefixes:
                if text[at:n] in self.mapping:
                    best, end = self.mapping[text[at:n]], n
                n += 1
        return best, end

    def apply(self, text: str) -> str:
        """The output of the input's one path."""
        if self.plain:
            out = text.replace(" ", MARK)
            return MARK + out if text and self.prefix else out
        out, at, spaced = [], 0, self.fold
        while at < len(text):
            chars, at = self._read(text, at)
            for c in chars:
                if c == " " and spaced and self.fold:
                    continue
                out.append(MARK if c == " " else c)
                spaced = c == " "
        whole = "".join(out)
        whole = whole.rstrip(MARK) if self.fold else whole
        return MARK + whole if whole and self.prefix else whole


class PieceFst:
    """The compiled transducers of one model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normaliser = {}, {}
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("spaces must be escaped, and stand before words")
        if DEFINED in self.kinds and normaliser.get(2):
            raise ValueError("pieces defined by a user beside a character map are not compiled")
        self.prefix = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(character_map(normaliser.get(2, b"")), self.prefix, bool(normaliser.get(4, 1)))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, DEFINED)}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece spans a word boundary")
        self._compile()
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.words = _Words(self)

    def _compile(self) -> None:
        #: The trie of the pieces: each prefix of one, with its id, or -1 if it is no piece itself.
        self.trie: dict[str, int] = {}
        for piece, i in self.ids.items():
            for n in range(1, len(piece)):
                self.trie.setdefault(piece[:n], -1)
            self.trie[piece] = i
        #: Byte fallback's arcs of characters met before.
        self.fallback: dict[str, tuple[int, ...]] = kept({})
        #: Weights of arcs met before: last piece -> piece -> weight.
        self.arcs: dict[int, dict[int, float]] = kept({})

    def _merge(self, text: str) -> list[str]:
        """BPE by rank: the best-scored neighbours first, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, where = -INFINITE, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, where = self.scores[piece], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def weight(self, last: int, piece: int) -> float:
        """Of the arc that reads `piece` after `last` (-1: at the start, or after bytes)."""
        if self.kind == UNIGRAM:
            return -self.scores[piece]
        b = self.pieces[piece]
        parts = self._merge(b if last < 0 else self.pieces[last] + b)
        return 0.0 if parts == ([b] if last < 0 else [self.pieces[last], b]) else INFINITE

    def spelled(self, char: str) -> tuple[int, ...]:
        """Byte fallback's output for a character that is no piece."""
        arc = self.fallback.get(char)
        if arc is None:
            arc = tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)
            self.fallback[char] = arc
        return arc

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path of a normalised text through the composed transducer."""
        n, trie, arcs = len(text), self.trie, self.arcs
        # for each position the states there: last piece -> (weight so far, position before, state before, ids of the arc)
        states: list[dict[int, tuple[float, int, int, tuple[int, ...]]]] = [{} for _ in range(n + 1)]
        states[0][-1] = (0.0, -1, -1, ())
        for i in range(n):
            here = states[i]
            if not here:
                continue
            if trie.get(text[i], -1) < 0:
                arc = self.spelled(text[i])
                for last, s in here.items():
                    old = states[i + 1].get(-1)
                    if old is None or s[0] + len(arc) < old[0]:
                        states[i + 1][-1] = (s[0] + len(arc), i, last, arc)
            for last, s in here.items():
                known = arcs.get(last)
                if known is None:
                    known = arcs[last] = {}
                for j in range(i + 1, n + 1):
                    piece = trie.get(text[i:j])
                    if piece is None:
                        break
                    if piece < 0:
                        continue
                    w = known.get(piece)
                    if w is None:
                        w = known[piece] = self.weight(last, piece)
                    if w < INFINITE:
                        w += s[0]
                        to = states[j]
                        if piece not in to or w < to[piece][0]:
                            to[piece] = (w, i, last, (piece,))
        if not states[n]:
            raise ValueError(f"no path through {text!r}")
        at, last = n, min(states[n], key=lambda p: states[n][p][0])
        out: list[tuple[int, ...]] = []
        while at > 0:
            _, before, state, arc = states[at][last]
            out.append(arc)
            at, last = before, state
        return [i for arc in reversed(out) for i in arc]

    _units = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def _units_of(self, whole: str) -> bytes:
        """Ids of a normalised text."""
        units = self._units.findall(whole) if self.kind == BPE else [whole] if whole else []
        return b"".join(array("I", self.shortest(u)).tobytes() for u in units)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return self._units_of(self.normaliser.apply(text))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """`encode` of a string column without nulls; for BPE, words are composed once."""
        import pyarrow.compute as pc

        if self.kind != BPE or not self.prefix:
            return [self.encode(t) for t in texts.to_pylist()]
        if not self.normaliser.plain:
            return self.words.encode(pa.array([self.normaliser.apply(t).replace(MARK, " ") for t in texts.to_pylist()], texts.type))
        space, none = pa.scalar(" ", texts.type), pa.scalar("", texts.type)
        return self.words.encode(pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(space, texts, none)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse transducers, bytes joined before they are read as UTF-8."""
        if not hasattr(self, "_spelled"):
            self._spelled = [
                b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)
            ]
        whole = b"".join([self._spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return whole[1:] if self.prefix and whole.startswith(" ") else whole


class _Words(PieceCache):
    """A transducer's paths by word, for texts with a space before them."""

    def __init__(self, fst: PieceFst):
        super().__init__(True, CACHE_ENTRIES)
        self.fst = fst

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.fst.shortest(w.replace(" ", MARK))).tobytes() if w else b"" for w in pieces]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.fst._units_of(t.replace(" ", MARK)) for t in texts]

    def _bound(self, piece: str) -> bool:
        return piece == " " or MARK in piece  # runs of marks merge


_compiled: dict[str, PieceFst] = {}


def compiled(path: str) -> PieceFst:
    """One transducer for each Python worker and model file."""
    if path not in _compiled:
        _compiled[path] = PieceFst(path)
    return _compiled[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every text."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = compiled(path)
        ids = [b for _, texts in text_blocks(batch.column("text"), BLOCK) for b in fst.encode_all(texts)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), of_batch, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of `encode`'s rows."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = compiled(path)
        texts = [fst.decode(np.frombuffer(b, "<u4")) for b in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded, of_batch, "doc_id long, text string")


def op7_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids, and of the text that they decode to, side by side with the text's own."""
    path = vocabulary("piece_bpe_32k.model")

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst, rows = compiled(path), []
        fallback = np.zeros(len(fst.pieces), bool)
        fallback[list(fst.bytes.values())] = True
        keys = batch.column("doc_id").to_pylist()
        for i, texts in text_blocks(batch.column("text"), BLOCK):
            for doc, text, data in zip(keys[i:], texts.to_pylist(), fst.encode_all(texts), strict=False):
                ids = np.frombuffer(data, "<u4")
                back = fst.decode(ids)
                rows.append((doc, len(ids), zlib.crc32(data), int(fallback[ids].sum()), hashlib.sha256(back.encode()).hexdigest(), back == text))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = ["doc_id", "n_ids", "ids_crc32", "n_bytes_pieces", "decoded_sha256", "round_trip"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text")).selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    return map_arrow(docs, of_batch, "doc_id long, n_ids long, ids_crc32 long, n_bytes_pieces long, decoded_sha256 string, round_trip boolean")
