"""Token files, packing and the piece transducer against the libraries."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, clashing, prose, table
from pyspark.sql import functions as F

from quillbase.llm import common, packing, piece_fst, token_files

BYTE, WORD, PIECE = (common.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path, special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if not special:
        t.encode_special_tokens = True  # as the vocabularies' README has it
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", " ", "\n", "a  b", " a", "a ", "\n\nx", "a\n b", "<|endoftext|> it's 's", "a\tb c", "\0 a b", "é́ ñ ́x", "A 'S x", "x\r\ny z", "ΑΣ Σ", "a. b, c! .d ,,e", "İ.", "日本。 x", "1. 2, 3", "don't.'", "ﬁ.", "a\u2009 b.", "Größe ÉCOLE naïve œuvre e\u0301té ªº µm Ǆ ẞ ſ İstanbul"]


@pytest.mark.parametrize(("path", "joined"), [(BYTE, True), (WORD, False)])
def test_cached_encoder(path, joined):
    own, want = common.CachedEncoder(path, joined, 40), library(path)  # generations come and go
    assert own.direct
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice("abcd  \n\t.,!é'1ΣSÄœIİ\u0301ſ") for _ in range(rng.randint(0, 14))) for _ in range(6)] + rng.sample(ODD, 3)
        assert own.encode(pa.array(texts)) == [np.array(want(t), "<u4").tobytes() for t in texts]
    sliced = pa.array(["skip", *ODD])[1:]
    assert own.encode(sliced) == [np.array(want(t), "<u4").tobytes() for t in ODD]


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize(("path", "joined"), [(BYTE, True), (WORD, False)])
def test_pieces_are_cut_where_tokens_end(path, joined, special):
    own, want, rng = common.CachedEncoder(path, joined, 60, special=special), library(path, special), random.Random(2)
    units = [*"abzAZ  \n\n.,;:!?'|<>$#*-_=()[]\\\"`~^&%+/@{}\t\r019é×÷ÀñςΣ中\u00a0\u2003\u0338\u0300İıK\x1c\0", "'s", "'ll", "<|endoftext|>", "word", "The"]
    for _ in range(200):
        texts = ["".join(rng.choices(units, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 20))]
        assert own.encode(pa.array(texts, pa.string())) == [np.array(want(t), "<u4").tobytes() for t in texts]


@pytest.mark.parametrize(("path", "joined"), [(BYTE, True), (WORD, False)])
def test_special_tokens_in_texts(path, joined):
    own, want = common.CachedEncoder(path, joined, 40, special=True), library(path, True)
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "<|startoftext|>x", "a <| b", "<|endoftext|>" * 3, " <|endoftext|>\n", "plain, text. é", *ODD]
    assert own.encode(pa.array(texts)) == [np.array(want(t), "<u4").tobytes() for t in texts]
    assert own.encode(pa.array(texts[:1])) != common.CachedEncoder(path, joined, 40).encode(pa.array(texts[:1]))


def test_token_files(spark, documents):
    folder, rows = documents
    got = token_files.op3_token_files(spark, folder).orderBy("start").collect()
    encode = library(BYTE)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    files = token_files.encode(spark.read.parquet(f"{folder}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long")), BYTE)
    assert files.select("part").distinct().count() > 1  # rows of one id are dealt to several tasks
    want = sorted(str((r[0], len(encode(r[1])) + 1, crc([*encode(r[1]), 2]))) for r in rows)
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == want


def test_random_access(spark, documents, monkeypatch):
    folder, _ = documents
    monkeypatch.setattr(token_files, "SHARD", 800)
    rng = random.Random(2)
    vocabulary = [rng.randrange(50257) for _ in range(12)]
    docs = [np.array([rng.choice(vocabulary) for _ in range(rng.randint(0, 400))] + [2], "<u4") for _ in range(60)]
    shard = token_files.Shard(token_files.body([d.tobytes() for d in docs]))
    assert len(shard.rules) > 5 and len(shard.symbols) < sum(map(len, docs))
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs)) and shard.sizes().tolist() == [len(d) for d in docs]
    whole = np.concatenate(docs)
    for _ in range(200):
        a = rng.randrange(len(whole))
        b = rng.randint(a, len(whole))
        assert (shard.ids(a, b) == whole[a:b]).all()
    files = token_files.encode(spark.read.parquet(f"{folder}/documents.parquet"), BYTE)
    assert files.count() > 3 and token_files.index(files).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_repair_is_a_grammar():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([2]), np.full(500, 7), rng.integers(0, 5, 3000), np.tile(rng.integers(0, 50257, 30), 80)):
        ids = ids.astype(np.uint32)
        symbols, rules = token_files.repair(ids)
        lengths = token_files.expansion_lengths(rules)
        expand = lambda s: [s] if s < token_files.TERMINALS else expand(int(rules[s - token_files.TERMINALS][0])) + expand(int(rules[s - token_files.TERMINALS][1]))
        assert [x for s in symbols for x in expand(int(s))] == ids.tolist()
        assert [len(expand(i + token_files.TERMINALS)) for i in range(len(rules))] == lengths.tolist()
        assert not (rules == 2).any()
    with pytest.raises(ValueError):
        token_files.body([np.array([60000], "<u4").tobytes()])


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(2)
    phrase = rng.integers(3, 50257, 400)
    words = [rng.integers(3, 300, rng.integers(1, 30)) for _ in range(200)]
    text = np.concatenate([words[min(int(k), 199)] for k in rng.exponential(30, 4000)])
    for ids in (np.tile(phrase, 600), np.full(70_000, 9), text, np.where(rng.random(len(text)) < 0.01, 2, text), np.tile([5, 6, 5, 7, 5], 5000)):
        symbols, rules = token_files.repair(ids.astype(np.uint32))
        pairs = Counter((a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist()) if 2 not in (a, b))
        assert max(pairs.values(), default=0) < token_files.LEAST and len(rules) < 65536 - token_files.TERMINALS
    symbols, rules = token_files.repair(np.tile(phrase, 600).astype(np.uint32))
    assert len(symbols) + 2 * len(rules) < 2500 and token_files.expansion_lengths(rules).max() > 400
    shard = token_files.Shard(token_files.body([np.tile(phrase, 600).astype("<u4").tobytes()]))
    assert (shard.document(0) == np.tile(phrase, 600)).all() and (shard.ids(777, 200_001) == np.tile(phrase, 600)[777:200_001]).all()


def test_packing(spark, documents):
    folder, rows = documents
    got = packing.op6_best_fit_packing(spark, folder).collect()
    encode = library(WORD)
    want = []
    for r in rows:
        ids = [*encode(r[1]), 0]
        want += [str((r[0], i, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]))) for i, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in got) // 2048)


def least_bins(lengths, room):
    """Exact, by depth-first search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= room and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_the_optimum():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.randint(*rng.choice([(1, 20), (4, 12)])) for _ in range(rng.randint(0, 11))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        patterns = packing.solve(histogram, 20)
        assert all(sum(p.lengths) <= 20 for p in patterns)
        used = {}
        for p in patterns:
            for n in p.lengths:
                used[n] = used.get(n, 0) + p.times
        assert used == histogram
        assert sum(p.times for p in patterns) == least_bins(lengths, 20) >= packing.lower_bound(histogram, 20)
    mixed = packing.solve({700: 1000, 690: 1000, 660: 999, 40: 3})  # best fit alone takes 1250
    assert sum(p.times for p in mixed) == 1125
    for _ in range(5):  # by thirds and quarters of a sequence, where best fit is poor
        histogram = {rng.randint(400, 1100): rng.randint(1, 300) for _ in range(6)}
        found = [sum(p.times for p in packing.solve(histogram, effort=e)) for e in (0, 200_000)]
        assert packing.lower_bound(histogram) <= found[1] <= found[0]
    big = {n: 10**9 + n for n in range(1, 2049)}
    assert sum(p.times for p in packing.solve(big)) <= -(-sum(n * c for n, c in big.items()) // 2048) * 1.001


def fits_into(small, large):
    """Whether the pieces of one filling, in groups, fit into those of another."""
    if not small:
        return True
    return any(fits_into(small[1:], [*large[:i], x - small[0], *large[i + 1 :]]) for i, x in enumerate(large) if x >= small[0])


def test_completions_are_the_undominated_ones():
    rng = random.Random(4)
    for _ in range(60):
        pieces, room = [rng.randint(1, 9) for _ in range(rng.randint(0, 7))], rng.randint(1, 14)
        counts = {n: pieces.count(n) for n in set(pieces)}
        got = list(packing.completions(counts, room))
        every = {tuple(sorted((p for p, t in zip(pieces, take) if t), reverse=True)) for take in itertools.product([0, 1], repeat=len(pieces))}
        every = {f for f in every if sum(f) <= room}
        want = {f for f in every if not any(g != f and fits_into(list(f), list(g)) for g in every)}
        assert [w for w, _ in got] == sorted(room - sum(f) for _, f in got)
        assert {f for _, f in got} == want or (room in counts and [f for _, f in got] == [(room,)])


def test_pieces_against_the_library(spark, documents):
    import sentencepiece

    folder, rows = documents
    sp, fst = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_fst.PieceFst(PIECE)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde  \n\tthe in er.,ñ日é▁12''") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" + " " * k + "y" for k in range(40)]
    for t in texts:
        ids = np.frombuffer(fst.encode(t), "<u4")
        assert fst.encode_all(pa.array(["", t, t + " x"])) == [b"", ids.tobytes(), fst.encode(t + " x")]
        assert ids.tolist() == sp.encode(t) and fst.decode(ids) == sp.decode(sp.encode(t))
    got = sorted(str((r.doc_id, r.n_ids, r.ids_crc32, r.round_trip)) for r in piece_fst.op7_sentencepiece_fst(spark, folder).collect())
    assert got == sorted(str((r[0], len(sp.encode(r[1] or "")), crc(sp.encode(r[1] or "")), True)) for r in rows)
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in piece_fst.decode(piece_fst.encode(docs, PIECE), PIECE).collect()} == {1: "Hello  world", 2: ""}


def field(number, data):
    n, size = len(data), b""
    while True:
        size += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return bytes([number << 3 | 2]) + size + data


@pytest.mark.parametrize(("rule", "prefix", "fold"), [("nmt_nfkc", 1, 1), ("nfkc_cf", 1, 0), (None, 1, 1), ("nmt_nfkc", 0, 1), (None, 0, 0)])
def test_normalisers_against_the_library(tmp_path, rule, prefix, fold):
    import sentencepiece

    blob = b""
    if rule:
        spec = dict(piece_fst._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
        blob = dict(piece_fst._fields(spec))[2]
    own = field(1, b"own") + (field(2, blob) if blob else b"") + bytes([3 << 3, prefix, 4 << 3, fold, 5 << 3, 1])
    parts, data = [], open(PIECE, "rb").read()
    for number, value in piece_fst._fields(data):
        parts.append(field(3, own) if number == 3 else field(number, value))
    (tmp_path / "model").write_bytes(b"".join(parts))
    sp, fst = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "model")), piece_fst.PieceFst(str(tmp_path / "model"))
    assert fst.normaliser.plain == (not rule and not fold)
    rng = random.Random(9)
    texts = ["", " ", "  a  b ", "Ｈｅｌｌｏ  ① ﬁ\u3000x ", "e\u0301", "\u00a0 \u00a0", "½ ㌔ ﷺ", "a\tb\nc\r\nd", "STRASSE ß İ", "\u200b x\u200b"]
    texts += ["".join(rng.choice("abcde  \n\tthe in ＡｂＣ①②ﬁé\u0301\u3000½ñ日ｶﾞ") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(fst.encode(t), "<u4").tolist() == sp.encode(t), t
    assert fst.encode_all(pa.array(texts)) == [fst.encode(t) for t in texts]


def test_unigram_takes_the_shortest_path():
    fst = piece_fst.PieceFst.__new__(piece_fst.PieceFst)
    fst.kind, fst.pieces, fst.scores = piece_fst.UNIGRAM, ["a", "b", "ab", "abb"], [-1.0, -1.0, -1.5, -4.0]
    fst.ids, fst.bytes, fst.unknown = {p: i for i, p in enumerate(fst.pieces)}, {}, 9
    fst._compile()
    assert fst.shortest("abb") == [2, 1] and fst.shortest("aab") == [0, 2] and fst.shortest("axb") == [0, 9, 1]


def test_empty_tables_and_clashing_columns(spark, nothing):
    for query in (token_files.op3_token_files, packing.op6_best_fit_packing, piece_fst.op7_sentencepiece_fst):
        assert query(spark, nothing).collect() == []
    df = clashing(spark)
    assert packing.pack(df).select("doc_id", "piece").count() >= df.count()
    assert token_files.index(token_files.encode(df, BYTE)).count() == df.count()


def test_long_text(spark, tmp_path):
    text = prose(random.Random(6), 60_000)
    table(spark, str(tmp_path), [(1, text, None, None, None)])
    ids = [*library(BYTE)(text), 2]
    row = token_files.op3_token_files(spark, str(tmp_path)).first()
    assert (row.n_tokens, row.ids_crc32) == (len(ids), crc(ids))
    assert SCHEMA.names[0] == "doc_id"
