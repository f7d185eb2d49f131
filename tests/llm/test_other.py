"""URL filter, toxicity, media chunks and the pipeline."""

import hashlib
import math
import os
import random
import types
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, clashing, prose, rows, table
from pyspark.sql import functions as F

from quillbase.llm import media_chunks as mc
from quillbase.llm import toxicity as tx
from quillbase.llm import url_filter as uf

# -- urls


def plain(rules, host, path, default="allow"):
    """Longest rule by a look at every rule."""
    fits = [(r[1].count(".") + 1, len(r[2]), r[0] == "block", r[1] + r[2], r[0]) for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits)[3:] if fits else (None, default)


URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "https://Shop.EXAMPLE.com/en/75?x#y", "http://example.com/en/8", "http://com/en/", "http://notexample.com/en/7", "http://a.b.example.net/de/8/q", "http://net/de/9", "http://example.net/de",
    "http://x.org/es/?a=/en/", "http://x.org?/es/", "http://x.org#/es/", "ftp://u:p@x.org:80/es/1", "http://É.ORG/es/", "a://b://c/en/", "http://x.com/en/\nz", "http://x.com/EN/",
]


def test_urls(spark, tmp_path):
    spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = uf.op4_url_filter(spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duckdb.sql(uf.SQL).fetchall()))
    for r in got.collect():
        assert (r.rule, r.verdict) == plain(uf.RULES, r.host, r.path)


def test_trie_against_every_rule():
    rng = random.Random(1)
    labels, parts = ["a", "b", "com", "net"], ["x", "y", "xy", ""]
    for _ in range(200):
        rules = {(".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), "/" + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))): rng.choice(["allow", "block"]) for _ in range(8)}
        rules = [(v, h, p) for (h, p), v in rules.items()]
        trie = uf.build(rules)
        for _ in range(30):
            host, path = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))), "/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            assert (uf.lookup(trie, host, path) or (None, "allow")) == plain(rules, host, path)
    both = uf.build([("allow", "a", "/x"), ("block", "a", "/x")])
    assert uf.lookup(both, "a", "/x") == ("a/x", "block") == uf.lookup(uf.build([("block", "a", "/x"), ("allow", "a", "/x")]), "a", "/x")
    for bad in (("no", "a", "/"), ("allow", "a", "x")):
        with pytest.raises(ValueError):
            uf.build([bad])


def test_url_frames(spark):
    df = spark.createDataFrame([("http://x.com/en/1", "h", "r"), ("http://x.de/", "h", "r"), (None, "h", "r")], "url string, host string, rule string")
    out = uf.filter_urls(df, uf.RULES)
    assert out.columns == df.columns and sorted(str(r.url) for r in out.collect()) == ["None", "http://x.de/"]
    assert uf.with_verdicts(df.select("url").limit(0), []).collect() == []
    both = uf.with_verdicts(df.withColumn("own_host", F.lit("x")), uf.RULES)
    assert both.columns == ["url", "own_own_host", "own_rule", "own_host", "host", "path", "rule", "verdict"]
    assert {(r.own_own_host, r.own_host, r.own_rule) for r in both.collect()} == {("h", "x", "r")} and sorted(r.host for r in both.collect()) == ["", "x.com", "x.de"]
    wide = clashing(spark).withColumn("url", F.concat(F.lit("http://x.com/"), F.col("lang"), F.lit("/")))
    kept = uf.filter_urls(wide, uf.RULES)
    assert kept.columns == wide.columns and kept.count() == wide.where("lang IS NULL OR lang <> 'en'").count()


def test_long_lists_are_joined(spark, monkeypatch):
    rng = random.Random(7)
    labels, parts = ["a", "b", "com", "net"], ["x", "y", "xy", ""]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(["", "/" + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))])) for _ in range(60)]
    urls = URLS + [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(parts) for _ in range(rng.randint(0, 4)))}" for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    for own in (list(uf.RULES) + rules, []):
        frame = spark.createDataFrame(own, "verdict string, host string, path string")
        want = sorted(map(str, uf.with_verdicts(df, own).collect()))
        assert sorted(map(str, uf.with_verdicts(df, frame).collect())) == want
        monkeypatch.setattr(uf, "MAX_BYTES", 4)
        monkeypatch.setattr(uf, "MAX_RULES", -1)
        assert sorted(map(str, uf.with_verdicts(df, own).collect())) == want == sorted(map(str, uf.with_verdicts(df, frame).collect()))
        monkeypatch.undo()


# -- toxicity


def test_toxicity(spark, tmp_path):
    rng = random.Random(2)
    own, labels = [], []
    for i in range(1200):
        words = prose(rng, rng.randint(30, 150)).split()
        toxic = i % 6 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "you loser"]))
        own.append((i, " ".join(words), "en", f"toxic{toxic}", None))
        labels.append((i, 1, int(toxic)))
    table(spark, str(tmp_path), own + [(2000, None, None, None, None), (2001, "", None, None, None)], labels)
    got = tx.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 1202
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) / len(held) > 0.95
    model = tx.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert 0 < len(model.at) < 5000


def test_toxicity_edges(spark, nothing, documents):
    assert tx.op5_toxicity(spark, nothing).collect() == []
    folder, own = documents
    assert tx.op5_toxicity(spark, folder).count() == len(own)
    none = tx.fit(clashing(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tx.score(clashing(spark), none).collect()} == {0.5}
    every, row = tx.features(pa.array(["", "One two three", "one TWO, three."]))
    assert row.tolist().count(1) == row.tolist().count(2) == 6 and sorted(every[row == 1]) == sorted(every[row == 2])


def plain_ftrl(rows, epochs, alpha, beta, l1):
    """FTRL-proximal coordinate by coordinate, in plain Python."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha)

    for _ in range(epochs):
        for label, at in rows:
            w = {i: weight(i) for i in at}
            b = -bias[0] / ((beta + bias[1] ** 0.5) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
            for i in at:
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias = [bias[0] + g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / alpha * b, bias[1] + g * g]
    return {i: weight(i) for i in z if weight(i)}, -bias[0] / ((beta + bias[1] ** 0.5) / alpha)


def test_weights_and_scores_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    words = prose(rng, 40).split()
    own = [(i, " ".join([*rng.choices(words, k=rng.randint(0, 30)), *(["Scum!"] if i % 4 == 0 else [])]), None, None, None) for i in range(200)]
    table(spark, str(tmp_path), own, [(i, 1, int(i % 4 == 0)) for i in range(200)])
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    sample = tx.training_rows(docs, labels, 90)
    assert len(sample) <= 90 and sum(y for y, _ in sample) <= 45
    model = tx.fit(docs, labels, rows=90, epochs=6, l1_of_root=0.1)
    weights, bias = plain_ftrl([(y, at.tolist()) for y, at in sample], 6, 0.5, 1.0, 0.1 * len(sample) ** 0.5)
    assert set(model.at.tolist()) == set(weights) and len(weights) > 3
    assert max(abs(weights[i] - w) for i, w in zip(model.at.tolist(), model.weight)) < 1e-9 and abs(bias - model.bias) < 1e-9
    for r in tx.score(docs, model).collect():
        (text,) = (t for i, t, *_ in own if i == r.doc_id)
        ids = {int(x) for x in tx.features(pa.array([text]))[0]}
        w = [p for p in (q.strip(tx._STRIP) for q in text.lower().split()) if p]
        assert len(ids) <= len(set(w)) + len(set(zip(w, w[1:]))) + len(set(zip(w, w[2:])))
        assert abs(r.score - 1 / (1 + math.exp(-sum(weights.get(i, 0.0) for i in ids) - bias))) < 1e-9


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (7, 1)], "doc_id long, toxic int")
    assert len(tx.training_rows(docs, labels, 10)) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2))


def test_ftrl_is_sparse():
    model, rng = tx.Ftrl(l1=5.0), np.random.default_rng(0)
    for _ in range(2000):
        label = int(rng.random() < 0.5)
        model.learn(np.unique(np.r_[rng.integers(10, 500, 20), [label]]), label)
    w = model.weights(slice(None))
    assert w[1] > 1 and w[0] < -1 and (w != 0).sum() < 100


# -- media


def payload(text):
    data = (text or "").encode()
    return data, data + b"\xff" * (-len(data) % 576 if data else 576)


def test_media(spark, documents):
    folder, own = documents
    got = mc.op9_media_chunks(spark, folder).collect()
    want = []
    for r in own:
        data, whole = payload(r[1])
        want.append(str((r[0], len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))))
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == sorted(want)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert len({r.media_sha256 for r in got}) == len({r.payload_sha256 for r in got})
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and sum(x.doc_id == r.doc_id for x in got) == 1}
    for i, text in ((r[0], r[1]) for r in own if r[0] in by_id):
        whole = payload(text)[1]
        (ends,) = mc.cuts(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]), *mc.TEXT)
        parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
        stored = b"QCDC2\0\0\0" + len(parts).to_bytes(4, "big") + b"".join(hashlib.sha256(x).digest() + len(x).to_bytes(4, "big") for x in parts) + whole
        assert (by_id[i].media_bytes, by_id[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        counts = np.bincount(np.frombuffer(whole, np.uint8), minlength=256) / len(whole)
        values = dict(x.split("=") for x in by_id[i].feature.split(";"))
        mean = (counts * np.arange(256)).sum()
        want = (len(whole), mean, ((counts * np.arange(256) ** 2).sum() - mean**2) ** 0.5, -sum(p * math.log2(p) for p in counts if p))
        assert all(abs(float(values[k]) - w) < 1e-3 for k, w in zip(("samples", "mean", "deviation", "entropy"), want))


def test_chunks_are_shared(spark, tmp_path):
    rng = random.Random(3)
    middle = prose(rng, 120_000)
    own = [(i, prose(rng, 300) + middle + prose(rng, 300), None, None, None) for i in range(4)]
    table(spark, str(tmp_path), own)
    packs = mc.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).cache()
    every = mc.chunks(packs, mc.readers(packs)).cache()
    distinct = every.select("digest").distinct().count()
    assert distinct < 0.5 * every.count() and mc.canonical(every).count() == distinct == every.count() - mc.requests(every).count()
    got = {r.doc_id: r for r in mc.op9_media_chunks(spark, str(tmp_path)).collect()}
    for i, t, *_ in own:
        assert got[i].payload_sha256 == hashlib.sha256(payload(t)[1]).hexdigest()
    broken = packs.withColumn("data", F.when(F.col("data").isNotNull(), F.first("data", ignorenulls=True).over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)))))
    with pytest.raises(Exception, match="reads back"):
        mc.reconstruct(broken).collect()


@pytest.mark.parametrize("bits", [32, 256])
def test_any_filter_gives_the_same_rows(spark, documents, bits):
    folder, own = documents
    packs = mc.pack(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    got = mc.reconstruct(packs, bits).collect()
    assert sorted(r.payload.hex() for r in got) == sorted({hashlib.sha256(payload(r[1])[1]).hexdigest() for r in own})


def test_cuts():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 2_000_000).astype(np.uint8)
    (ends,) = mc.cuts(data, np.array([0, len(data)]))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= mc.MOST and (sizes[:-1] >= mc.LEAST).all() and 15_000 < sizes.mean() < 80_000
    (shifted,) = mc.cuts(np.concatenate([data[:777], data]), np.array([0, len(data) + 777]))
    assert len({e - 777 for e in shifted} & set(ends)) > 0.8 * len(ends)
    table_ = (mc.mix(np.arange(1, 257, dtype=np.uint64) * mc.GOLDEN) >> np.uint64(32)).astype(int)
    h = 0
    for i, b in enumerate(data[:500]):
        h = (h * 2 + int(table_[b])) % 2**32
        assert i < 32 or int(mc.gear(data[:500])[i]) == h if i % 50 == 0 else True
    assert mc.cuts(np.zeros(0, np.uint8), np.array([0])) == []
    assert len(mc.cuts(np.zeros(600_000, np.uint8), np.array([0, 600_000]))[0]) >= 5


def test_media_empty(spark, nothing):
    assert mc.op9_media_chunks(spark, nothing).collect() == []
    assert mc.pack(clashing(spark)).count() == len(rows())
    assert mc.reconstruct(mc.pack(clashing(spark)).cache()).count() == len({payload(r[1])[1] for r in rows()})


# -- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    shared = prose(rng, 70)
    own = [(i, prose(rng, 120), "en", "s", 1) for i in range(200)]
    own += [(200, own[0][1], "en", "s", 1), (201, own[1][1] + " more", "en", "s", 1), (202, "too short", "en", "s", 1), (203, " ".join(w + "***" for w in prose(rng, 80).split()), "en", "s", 1)]
    own += [(300 + i, f"{prose(rng, 90)}\n{shared}\n{prose(rng, 90)} password=abcdefgh{i}1", "en", "s", 1) for i in range(3)]
    own += [(400 + i, " ".join(w + "***" for w in prose(rng, 80).split()), "en", "s", 1) for i in range(60)]
    table(spark, str(tmp_path), own, [(i, 1, 0) for i in range(150)] + [(400 + i, 0, 0) for i in range(50)])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == SCHEMA.names
        df = corpus_pipeline.staged(df, "test")
        kept.append({r.doc_id: r.text for r in df.collect()})
    assert set(kept[0]) == {r[0] for r in own} - {202, 203} - set(range(400, 460))
    assert set(kept[0]) - set(kept[1]) == {200, 201}
    assert all(shared not in kept[2][300 + i] and len(kept[2][300 + i]) > 400 for i in range(3)) and kept[2][5] == own[5][1]
    assert all("[SECRET]" in kept[3][300 + i] and "password" not in kept[3][300 + i] for i in range(3))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept[3])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def plain_features(text):
    """The statistics that rules use, in plain Python."""
    import test_text_rules as tr

    words = tr.WORD.findall(text)
    lines = [x for x in text.split("\n") if tr.WORD.search(x)]
    n, chars, symbols, dup, repeat, _ = tr.counts(text)
    per = lambda x, of: x / max(of, 1)
    return {
        "symbol_ratio": per(symbols, chars), "dup_line_ratio": per(dup, len(lines)), "repeat_ratio": per(repeat, n), "mean_word_length": per(chars, n), "upper_ratio": per(sum(c.isupper() for c in text), chars),
        "punctuation_ratio": per(sum(c in ".,;:!?" for c in text), chars), "digit_ratio": per(sum(c in "0123456789" for c in text), chars), "distinct_ratio": per(len(set(words)), n),
        "words_per_line": per(n, len(lines)), "short_word_ratio": per(sum(len(w) <= 2 for w in words), n), "n_words": n,
    }


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import test_near_dedup as nd
    import test_suffix_dedup as sx
    import test_text_rules as tr
    import test_tokens as tk
    from quillbase.llm import quality_rules as qr

    rng = random.Random(21)
    plain = lambda n: prose(rng, n).replace("é", "e")
    shared, base = plain(70), plain(140)
    texts = [plain(rng.choice([20, 60, 90, 200])) for _ in range(90)] + [" ".join(w + "***" for w in plain(80).split()) for _ in range(40)]
    texts += [base, base, base + " tail", f"{plain(80)}\n{shared} {plain(60)}", f"{plain(80)} {shared}\n{plain(60)}", f"{plain(90)} password=abcdefgh1 {'0f' * 20} {plain(30)}", None, "", plain(6000)]
    own = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    table(spark, str(tmp_path), own, [(i, int(not 90 <= i < 130), 0) for i in range(130)])
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    rules = qr.fit(docs, labels)
    assert rules
    kept = []
    for r in own:
        x = {k: np.array([v], float) for k, v in plain_features(r[1] or "").items()}
        if not tr.counts(r[1])[-1] and not any(rule.holds(x)[0] for rule in rules):
            kept.append(r)
    roots = nd.brute(kept, True)
    kept = [r for i, r in enumerate(kept) if r[0] == min(s[0] for s, c in zip(kept, roots) if c == roots[i])]
    count = Counter(t[i : i + 200] for _, t, *_ in kept for i in range(len(t) - 199))
    cut = []
    for i, t, *_ in kept:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        cut.append((i, "".join(c for c, g in zip(t, gone) if not g)))
    assert sum(b[1] for b in sx.brute([r[1] for r in kept])) == sum(len(r[1]) for r in kept) - sum(len(t) for _, t in cut) > 0
    want = []
    encode = tk.library(tk.WORD)
    for i, text in cut:
        clean, at = "", 0
        for a, _, b in tr.spans(text):
            clean += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        ids = [*encode(clean + text[at:]), 0]
        want += [str((i, k, a, len(ids[a : a + 2048]), tk.crc(ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    used = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) == -(-sum(used.values()) // 2048)


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    from quillbase.llm import common

    assert common.shared_dir(spark) == common.shared_dir(spark)
    for master, there in (("local[4]", True), ("local-cluster[2,1,512]", False), ("spark://host:7077", False), ("yarn", False)):
        fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
        if there:
            assert common.shared_dir(fake).startswith("file:///")
        else:
            with pytest.raises(RuntimeError):
                common.shared_dir(fake)
    df = common.staged(spark.range(10), "x")
    assert df.count() == 10 and os.path.basename(df.inputFiles()[0]).startswith("part-")
