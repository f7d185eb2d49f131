import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, clashing, prose
from pyspark.sql import functions as F

from quillbase.llm import suffix_dedup as sd


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def bag(df):
    return sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())))


def expected(rows):
    return sorted(map(str, ((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))))


def test_against_brute_force(spark, documents):
    folder, rows = documents
    assert bag(sd.op1_suffix_dedup(spark, folder)) == expected(rows)


@pytest.mark.parametrize("wide", [1, 150])
def test_wide_buckets_agree(spark, documents, monkeypatch, wide):
    folder, rows = documents
    monkeypatch.setattr(sd, "WIDE", wide)
    assert bag(sd.op1_suffix_dedup(spark, folder)) == expected(rows)


def test_random_repetitive_texts(spark, tmp_path):
    rng = random.Random(5)
    parts = [prose(rng, k) for k in (5, 30, 60, 60)] + ["abc" * 40, "z" * 150]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 8))), None, None, None) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert bag(sd.op1_suffix_dedup(spark, str(tmp_path))) == expected(rows)


def test_long_periodic_texts(spark, tmp_path):
    rng = random.Random(6)
    cycle = "".join(rng.choice("abcdefgh") for _ in range(37))
    rows = [(1, "a" * 9001, None, None, None), (2, cycle * 400, None, None, None), (3, prose(rng, 50) + cycle * 300 + prose(rng, 90), None, None, None), (4, "b" * 4300 + "c", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert bag(sd.op1_suffix_dedup(spark, str(tmp_path))) == expected(rows)


def test_empty_table(spark, nothing):
    assert sd.op1_suffix_dedup(spark, nothing).collect() == []


def test_maximal_intervals_are_those_of_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 40))).encode() for _ in range(4)]
        least = 3
        got = {(depth, tuple(sorted(members))) for depth, members in sd.repeats_in_runs(parts, [1] * 4, least)}
        strings = {}
        for i, p in enumerate(parts):
            for a in range(len(p)):
                for b in range(a + least, len(p) + 1):
                    strings.setdefault(p[a:b], []).append((i, a))
        deepest = {}
        for depth, members in sd.repeats_in_runs(parts, [1] * 4, least, listed=False):
            deepest.update({m: max(depth, deepest.get(m, 0)) for m in members})
        assert deepest == {m: max(d for d, at in got if m in at) for _, at in got for m in at}
        want = set()
        for s, at in strings.items():
            if len(at) > 1:
                lefts = {parts[i][a - 1] if a else (i, "start") for i, a in at}
                rights = {parts[i][a + len(s)] if a + len(s) < len(parts[i]) else (i, "end") for i, a in at}
                if len(lefts) > 1 and len(rights) > 1:
                    want.add((len(s), tuple(sorted(at))))
        assert got == want


def test_spans_of_long_runs():
    rng = random.Random(8)
    for _ in range(40):
        pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([30, 300, 900]))) for _ in range(3)] + [b"ab" * 300, b"z" * 700]
        parts = [b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(4)]
        got = [bytearray(len(p)) for p in parts]
        for size, members in sd.repeats_in_runs(parts, [1] * 4, 200, listed=False):
            for run, begin in members:
                got[run][begin : begin + size] = b"\1" * size
        count = Counter(p[i : i + 200] for p in parts for i in range(len(p) - 199))
        for p, g in zip(parts, got):
            want = bytearray(len(p))
            for i in range(len(p) - 199):
                if count[p[i : i + 200]] > 1:
                    want[i : i + 200] = b"\1" * 200
            assert g == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for length in (3, 20):
        parts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (50, 20, 300, 24)] + [b"ab" * 200, b"a" * 77]
        array = sd.SuffixArray(parts, length)
        suffixes = [parts[array.run[i]][array.begin[i] :] for i in array.order]
        assert sorted(suffixes) == sorted(p[i:] for p in parts for i in range(len(p) - length + 1))
        groups = [list(g) for _, g in itertools.groupby(suffixes, lambda x: x[:length])]
        assert len({g[0][:length] for g in groups}) == len(groups) and all(g == sorted(g) for g in groups)
        for a, b, n in zip(suffixes, suffixes[1:], array.prefix[1:]):
            common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert n == (common if common >= length else 0)


def test_occurrences_name_groups(spark):
    rng = random.Random(9)
    shared = prose(rng, 60)
    rows = [(i, f"{prose(rng, 50)} {shared} {prose(rng, 50)}", None, None, None) for i in range(3)]
    found = sd.occurrences(spark.createDataFrame(rows, SCHEMA))
    groups = found.groupBy("repeat").agg(F.countDistinct("k1", "k2").alias("texts"), F.max("size").alias("size")).collect()
    assert groups and all(g.texts == 3 for g in groups) and max(g.size for g in groups) >= 200


def test_deduplicate_keeps_rows_and_columns(spark):
    df = clashing(spark)
    out = sd.deduplicate(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("doc_id IS NULL AND text IS NULL").count() == 1
    assert out.where("h <> 'own h'").count() == 0
    want = Counter()
    rows = df.collect()
    for r, b in zip(rows, brute([r.text for r in rows])):
        want[r.doc_id, b[3]] += 1
    got = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert sum((want - got).values()) <= 2  # only texts cut within a character differ


@pytest.mark.parametrize("size", [0, 1, 199, 200, 201, 5000])
def test_block_runs_cover_every_suffix(size):
    data = np.random.default_rng(size).integers(0, 4, size).astype(np.uint8)
    text, start, count, loop, h, d = sd.block_runs(data, np.array([0, size]), 200, 64)
    assert sorted(s + k for s, n in zip(start, count) for k in range(n)) == list(range(max(0, size - 199)))
