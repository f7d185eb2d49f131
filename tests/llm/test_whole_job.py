"""Cases in which operators once did less than the whole job."""

import random
import re

import numpy as np
import pyarrow as pa
from cases import SCHEMA, prose
from pyspark.sql import functions as F

from quillbase.llm import bag_minhash as bm
from quillbase.llm import media_chunks as mc
from quillbase.llm import secret_scan as ss
from quillbase.llm import toxicity as tx


def test_texts_of_typical_length_share_chunks(spark):
    rng = random.Random(11)
    middle = prose(rng, 700)
    own = [(i, f"{prose(rng, 60)} {middle} {prose(rng, 60)}", None, None, None) for i in range(40)]
    packs = mc.pack(spark.createDataFrame(own, SCHEMA))
    every = packs.select(F.explode("digests").alias("digest"))
    total, distinct = every.count(), every.distinct().count()
    stored = sum(len(t.encode()) for _, t, *_ in own)
    assert 500 < stored / total < 2048 and distinct < 0.75 * total


def test_a_payload_that_is_another_ones_chunk(spark, tmp_path):
    rng = random.Random(15)
    raw = "".join(rng.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(3_000_000)).encode()
    (ends,) = mc.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), *mc.TEXT)
    a, b = next((a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if (b - a) % mc.UNIT == 0)
    short, long = raw[a:b].decode(), raw[a : b + 20_000].decode()
    for k, own in enumerate([[(1, short), (2, long)], [(2, long), (1, short)], [(2, long), (1, short), (3, short), (4, long)]]):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in own], SCHEMA).coalesce(1)
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        packs = mc.pack(docs).cache()
        assert packs.where("size(digests) = 1 AND doc_id = 1").count() == 1 and packs.where("size(digests) > 1 AND doc_id = 2").count() == 1
        got = {r.doc_id: r.payload_bytes for r in mc.op9_media_chunks(spark, f"{tmp_path}/{k}").collect()}
        assert got == {i: len(mc.payloads(docs.where(f"doc_id = {i}").toArrow().column("text").combine_chunks())[0][0]) for i, _ in own}


def shuffled_records(spark, action):
    """What `action` gives, and the records that its stages wrote to shuffles."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return action(), total() - before


def test_chunks_of_one_place_are_not_moved_to_find_requests(spark):
    rows = [(i, 0, i.to_bytes(32, "big")) for i in range(20_000)] + [(20_000 + i, 1, (i % 50).to_bytes(32, "big")) for i in range(100)]
    chunks = spark.createDataFrame(rows, "place long, seq int, digest binary").repartition(4).localCheckpoint()
    own, at = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(own, "-1")
    try:
        found, moved = shuffled_records(spark, lambda: mc.requests(chunks).collect())
    finally:
        spark.conf.set(own, at)
    assert sorted((r.place, r.seq, r.digest, r.holder, r.holder_seq) for r in found) == [(p, s, d, p % 50, 0) for p, s, d in rows[20_000:]]
    assert moved < 1.2 * len(rows)  # once, to count the places of each digest


def test_runs_beside_an_equals_sign_are_tested(spark):
    rng = random.Random(12)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    own = []
    for i in range(40):
        run = "".join(rng.choice(alphabet) for _ in range(40))
        before, after = [("export AWS_KEY=", " x"), ("http://a.b/c?sig=", "&d=e"), ("?", "=value"), ("k==", "== y")][i % 4]
        own.append((i, f"é {before}{run}{after}", run))
    own += [(100 + i, prose(rng, 30), None) for i in range(40)]
    docs = spark.createDataFrame(own, "doc_id long, text string, run string")
    found = {r._row.doc_id: [r._row.text[s.start : s.end] for s in r.spans] for r in ss.scan(docs).collect()}
    for kind in range(4):
        assert sum(any(run in part for part in found[i]) for i, _, run in own[:40] if i % 4 == kind) >= 9
    assert not any(found[i] for i in range(100, 140))
    masked = {r.doc_id: r.text for r in ss.redact(docs).collect()}
    assert sum(run not in masked[i] for i, _, run in own[:40]) >= 36


def test_structured_runs_hold_every_word_of_every_text(spark):
    rng = random.Random(16)
    texts = [prose(rng, n).replace(" of ", "\n- ") + " x9y " + "a" * 25 + " end" for n in (0, 3, 30, 62, 63, 64, 126, 127, 128, 700, 9000)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    runs = {r.doc_id: r.runs for r in docs.select("doc_id", ss._glued(ss.text_or_empty()).alias("runs")).collect()}
    for i, text in enumerate(texts):
        letters = "".join(re.sub("[^A-Za-z]", "", w) for w in text.split() if not re.search("[0-9]|[A-Za-z+/_-]{20}", w)).lower()
        assert re.sub("[^a-z]", "", "".join(runs[i]).lower()) == (letters if runs[i] else "") and all(len(r) >= 20 for r in runs[i])
        assert runs[i] or len(letters) < 20
    assert runs[99] == [] and len({re.sub("[A-Za-z]", "", r)[:1] for r in runs[10]}) == 3
    tested = {r.doc_id: r.n for r in ss.candidates(docs, ("doc_id",)).select("_row.doc_id", F.size("_decoys").alias("n")).collect()}
    assert tested == {i: len(r) for i, r in runs.items()}


def test_structured_runs_are_made_once_and_scored_by_compiled_steps(spark):
    rng = random.Random(17)
    docs = spark.createDataFrame([*enumerate(prose(rng, n) for n in (0, 3, 200, 3000)), (99, None)], "doc_id long, text string")
    every = ss.candidates(docs, ("doc_id",))
    runs = ss.structured(every)
    assert sorted(r.run for r in runs.collect()) == sorted(x for r in every.collect() for x in r._decoys)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 2 and "regexp_extract_all" in plan  # of the text and of each lot
    own = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) + "=" * (i % 3) for a, _, _ in ss.ALPHABETS for i in range(9)] + ["a-b_c/d+" * 4, "-" * 20, "A" * 300]
    every_run = runs.union(spark.createDataFrame([(r,) for r in own], "run string"))
    scored = ss.cells(every_run, "run")
    one_by_one = every_run.select(ss._cell(F.col("run")).alias("c"))
    assert sorted(tuple(r.c) for r in scored.collect()) == sorted(tuple(r.c) for r in one_by_one.collect())
    steps = ss.cells(spark.createDataFrame([(r,) for r in own], "run string"), "run")._jdf.queryExecution().executedPlan().toString()
    assert sum("lambdafunction" in line for line in steps.splitlines()) == 1


def test_one_row_of_each_class_whatever_the_ids(spark):
    rng = random.Random(13)
    alone = [prose(rng, 60) for _ in range(5)]
    own = [(None, t, "en", "s", 1) for t in alone[:3]] + [(None, alone[0], "en", "s", 1), (7, alone[3], "en", "s", 1), (7, alone[4], "en", "s", 1), (9, alone[3] + " tail", "en", "s", 1), (8, alone[1], "en", "s", 1)]
    kept = sorted((str(r.doc_id), r.text) for r in bm.deduplicate(spark.createDataFrame(own, SCHEMA)).collect())
    assert kept == sorted([("None", alone[0]), ("8", alone[1]), ("None", alone[2]), ("7", alone[3]), ("7", alone[4])])


def test_training_takes_all_features_of_a_row(spark):
    rng = random.Random(14)
    text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(3000))
    docs = spark.createDataFrame([(i, text, None, None, None) for i in range(8)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    sample = tx.training_rows(docs, labels, 100)
    want = len(set(tx.features(pa.array([text]))[0].tolist()))
    assert want > 8000 and sample and all(len(at) == want for _, at in sample)
