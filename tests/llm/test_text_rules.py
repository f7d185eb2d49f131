"""Quality rules and secret scans against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from cases import SCHEMA, clashing, prose, table
from pyspark.sql import functions as F

from quillbase.llm import quality_rules as qr
from quillbase.llm import secret_scan as ss

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_statistics(spark, tmp_path):
    rng = random.Random(1)
    own = [(i, t, None, None, None) for i, t in enumerate([None, "", "a b", "a b c a b c", "x\x0by\x0cz\r\n\tq", "a\na\n \n a\n \n ", "# * $% <b>|&", "z " * 300, prose(rng, 400) + "\n" + prose(rng, 30), "日本 語 日本 語 日本 語"])]
    own += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))), None, None, None) for i in range(30)]
    table(spark, str(tmp_path), own)
    got = {r.doc_id: r for r in qr.op8_quality_rules(spark, str(tmp_path)).collect()}
    for r in own:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == counts(r[1]), r
        assert not (g.base_failed and g.kept)


def junk(rng, n):
    return " ".join(w + "***" for w in prose(rng, n).split())


def test_learned_list_rejects_what_labels_reject(spark, tmp_path):
    rng = random.Random(2)
    own = [(i, junk(rng, 80) if i % 5 == 0 else prose(rng, 80), None, None, None) for i in range(300)]
    table(spark, str(tmp_path), own, [(i, int(i % 5 != 0), 0) for i in range(200)])
    got = qr.op8_quality_rules(spark, str(tmp_path)).where("NOT base_failed")
    assert got.where("kept = (doc_id % 5 = 0)").count() == 0 and got.count() > 250
    assert "Python" not in got._jdf.queryExecution().toString()


def test_decision_list_in_order():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | (x["b"] < 0.15)
    rules = qr.learn(x, bad, precision=0.9)
    assert all(x["a"][r.holds(x)].size for r in rules)
    hit = np.logical_or.reduce([r.holds(x) for r in rules])
    assert len(rules) >= 2 and (hit == bad).mean() > 0.97
    assert qr.learn(x, np.zeros(900, bool)) == [] and qr.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_best_condition_against_every_threshold():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = {"a": rng.integers(0, 9, 60).astype(float), "b": rng.random(60)}
        bad, covered = rng.random(60) < 0.3, rng.random(60) < 0.8
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        gain = lambda p, n: p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p >= 3 else 0.0
        want = max(gain((covered & bad & h).sum(), (covered & ~bad & h).sum()) for f in x for t in x[f] for h in (x[f] > t, x[f] <= t))
        c = qr._Cuts(x).best(covered, bad, 3)
        got = gain((covered & bad & c.holds(x)).sum(), (covered & ~bad & c.holds(x)).sum()) if c else 0.0
        assert abs(got - max(want, 0.0)) < 1e-9


def test_a_rule_that_fails_does_not_end_the_covering():
    rng = np.random.default_rng(6)
    x = {"a": rng.random(1500), "b": rng.random(1500)}
    bad = ((x["a"] > 0.5) & (x["a"] < 0.95) & (rng.random(1500) < 0.7)) | (x["b"] > 0.9)  # the first half can't be told well
    rules = qr.learn(x, bad, precision=0.97)
    assert any(c.feature == "b" and c.above for r in rules for c in r.conditions)
    assert np.logical_or.reduce([r.holds(x) for r in rules])[x["b"] > 0.9].mean() > 0.9


def test_sample_is_one_row_of_each_labelled_id(spark):
    docs = spark.createDataFrame([(i % 2 or None, f"text {i} " * 60) for i in range(300)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [(r._row.doc_id, r._row.quality) for r in qr.labelled_sample(docs, labels, 10).collect()] == [(1, 0)]


def test_rules_as_columns(spark):
    rules = [qr.Rule((qr.Condition("symbol_ratio", True, 0.5), qr.Condition("n_words", False, 3.0)), 1.0, 9), qr.Rule((qr.Condition("n_words", False, 3.0),), 1.0, 9)]
    df = spark.createDataFrame([(0.9, 2), (0.1, 2), (0.9, 9)], "symbol_ratio double, n_words long")
    assert [r[0] for r in df.select(qr.verdict(rules)).collect()] == [1, 2, 0]


def test_quality_edges(spark, nothing, documents):
    assert qr.op8_quality_rules(spark, nothing).collect() == []
    folder, rows = documents
    assert qr.op8_quality_rules(spark, folder).count() == len(rows)
    df = clashing(spark)
    out = qr.stage(spark, df, folder)
    assert out.columns == df.columns and 0 < out.count() < df.count()
    assert qr.stage(spark, df, nothing).columns == df.columns  # no labels: the base rule alone


PATTERN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def spans(text):
    out = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


TRICKY = [
    None, "", "token=token:abcdefgh", "PassWord : 'abcdefghi' api_key=\"x\" apikey==........", "secret:secret=aaaaaaaa", "é日 passwd=日 passwd='12345678", "AKIAAKIAAKIAAKIA AKIA123", "AKIA" + "Z" * 12,
    "f" * 31 + " " + "f" * 32 + "G" + "0" * 64, "x" + "a" * 33 + "z", "token = " + "a1" * 20, "paſſword=abcdefgh1", "toKen=abcdefgh1", "secret=" + "a" * 7, "🙂 token=abcdefgh🙂" * 3,
    "password=" + "0f" * 16 + "\npassword=AKIA" + "Q" * 16,
]


def test_base_spans(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["token", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "Z9Z9", "0f0f0f0f", "secret", "é", "\n", "api_key"]
    texts = TRICKY + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    table(spark, str(tmp_path), [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in ss.op2_secret_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = spans(t or "")
        text = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_random_runs_are_told_from_words(spark, tmp_path):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(40)]
    words = ["".join(rng.choice(["tion", "heit", "schaft", "ment", "able", "ing"]) for _ in range(9)) for _ in range(150)] + ["1234567890" * 3, "abcdefghijklmnopqrstuvwxyz", "CamelCaseNamesAreNotSecretsAtAll", "some-long-path/with/many/parts-of-it"]
    own = [(i, f"a é {w} b", None, None, None) for i, w in enumerate(random_ + words)]
    table(spark, str(tmp_path), own)
    found = ss.op2_secret_scan(spark, str(tmp_path))
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in found.collect()}
    assert sum(got[i].n_random for i in range(40)) >= 36 and sum(got[i].n_random for i in range(40, len(own))) <= 1
    assert got[0].spans == "random:4:44" and got[0].n_assign == 0


def test_battery_against_plain_python(spark):
    import math

    rng, runs = random.Random(8), []
    for symbols, _, _ in ss.ALPHABETS:
        runs += ["".join(rng.choice(symbols) for _ in range(rng.randint(20, 70))) for _ in range(12)]
    runs += ["abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "a" * 30, "internationalisation-of-things", "A" * 20 + "b"]
    below = lambda z: 0.5 * math.erfc(-z / 2**0.5)
    got = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, run string").select("i", ss.battery(F.col("run")).alias("b")).collect()
    for r in got:
        run, b = runs[r.i], r.b
        which = next(i for i, a in enumerate(ss.ALPHABETS) if re.search(a[1], run))
        symbols, _, classes = ss.ALPHABETS[which]
        v = [symbols.index(c) for c in run.translate({45: 43, 95: 47})]
        n, size = len(v), len(symbols)
        chi = sum(size / n * c * c for c in Counter(v).values()) - n
        free = size - 1
        p_chi = below(-((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5)
        kind = [next(k for k in range(len(classes)) if x < sum(classes[: k + 1])) for x in v]
        share = [c / sum(classes) for c in classes]
        rate = 1 - sum(p * p for p in share)
        spread = (n - 1) * rate * (1 - rate) + 2 * (n - 2) * (sum(p * (1 - p) ** 2 for p in share) - rate * rate)
        p_runs = 2 * below(-abs(sum(x != y for x, y in zip(kind, kind[1:])) - (n - 1) * rate) / spread**0.5)
        x, y = np.array(v[:-1], float), np.array(v[1:], float)
        serial = np.corrcoef(x, y)[0, 1] if x.std() * y.std() > 0 else 1.0
        p_serial = 2 * below(-abs((serial + 1 / (n - 1)) * (n - 1) ** 0.5))
        assert (b.alphabet, b.n) == (which, n)
        for one, want in ((b.chi, p_chi), (b.runs, p_runs), (b.serial, p_serial)):
            assert abs(one - want) < 1e-6 + 0.1 * want
        half = -sum(math.log(max(p, 1e-300)) for p in (b.chi, b.runs, b.serial))
        assert abs(b.p - math.exp(-half) * (1 + half + half * half / 2)) < 1e-9


def test_false_discovery_control_against_plain_python():
    rng = random.Random(9)
    for fdr in (0.01, 0.2):
        counts = {(c, s): (rng.randint(0, 40) if s < 4 else rng.randint(0, 3), rng.randint(0, 2) if s < 4 else rng.randint(0, 400)) for c in range(3) for s in range(12)}
        got = ss.accepted([(c, s, *v) for (c, s), v in counts.items()], fdr)
        p = {(c, s): (1 + sum(d for (c2, s2), (_, d) in counts.items() if c2 == c and s2 <= s)) / (1 + sum(d for (c2, _), (_, d) in counts.items() if c2 == c)) for c, s in counts}
        every = sorted(p[c, s] for (c, s), (k, _) in counts.items() for _ in range(k))
        cut = max((x for i, x in enumerate(every, 1) if x <= fdr * i / len(every)), default=-1)
        for (c, s), (k, _) in counts.items():
            if k:
                assert (p[c, s] <= cut) == (s <= got.get(c, -1))
    assert ss.accepted([], 0.01) == {}


def test_serial_and_runs_tests_reject_words(spark):
    rng = random.Random(10)
    words = [f"{'-'.join(rng.choice(ss._WORDS) for _ in range(6))}" for _ in range(200)] + ["".join(rng.choice(ss._WORDS) for _ in range(5)) for _ in range(200)]
    even = ["".join(rng.choice(ss.ALPHABETS[6][0]) for _ in range(36)) for _ in range(400)]
    df = spark.createDataFrame([(w, i < 400) for i, w in enumerate(words + even)], "run string, word boolean").select("word", ss.battery(F.col("run")).alias("b")).select("word", "b.*")
    rates = {r.word: r for r in df.groupBy("word").agg(*[F.avg((F.col(k) < 0.05).cast("int")).alias(k) for k in ("chi", "runs", "serial", "p")]).collect()}
    assert rates[True].runs > 0.9 and rates[True].chi > 0.9 and rates[True].p > 0.98
    assert all(0.01 < rates[False][k] < 0.12 for k in ("chi", "runs", "serial", "p"))


def test_measured_false_discoveries(spark):
    """Structured runs of words that the reference runs don't use, among even draws."""
    rng = random.Random(11)
    other = "mountain river bridge castle garlic pepper candle ladder hammer blanket orange violin trumpet pencil carpet meadow".split()
    own = ["".join(rng.choice(other).title() if i % 3 else rng.choice(other) for _ in range(7)) if i % 2 else rng.choice("-_/").join(rng.choice(other) for _ in range(5)) for i in range(1500)]
    own += ["".join(rng.choice(ss.ALPHABETS[5 + i % 2][0]) for _ in range(rng.randint(24, 60))) for i in range(300)]
    docs = spark.createDataFrame([(i, f"see {r} there") for i, r in enumerate(own)], "doc_id long, text string")
    flagged = [r._row.doc_id for r in ss.scan(docs, ("doc_id",)).where("size(spans) > 0").collect()]
    false = sum(i < 1500 for i in flagged)
    assert len(flagged) - false > 270 and false <= 0.03 * len(flagged)


def test_many_spans_and_long_texts(spark):
    rng = random.Random(12)
    text = "".join(f"é{rng.randrange(10**6)} secret=abcdefgh{i % 7} " + "x " * rng.randint(0, 9) for i in range(3000)) + "🙂" * 5000 + " token=abcdefgh"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = ss.scan(docs).first()
    assert [(s.start, s.kind, s.end) for s in row.base] == spans(text)
    assert ss.redact(docs).first().text == PATTERN.sub("[SECRET]", text)


def test_redaction(spark, nothing):
    df = clashing(spark)
    out = ss.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    want = []
    for r in df.collect():
        text, at, clean = r.text or "", 0, ""
        for i, _, j in spans(text):
            clean += text[at:i] + "[SECRET]" if i >= at else ""
            at = max(at, j)
        want.append(str((r.doc_id, None if r.text is None else clean + text[at:])))
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(want)
    assert out.where("text LIKE '%[SECRET]%'").count() == 5
    some = spark.createDataFrame([(1, "password=" + "0f" * 16 + " tail"), (2, None), (3, "AKIA" + "Q" * 16 + "é")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in ss.redact(some).collect()} == {1: "[SECRET] tail", 2: None, 3: "[SECRET]é"}
    assert ss.op2_secret_scan(spark, nothing).collect() == [] and ss.redact(spark.createDataFrame([], SCHEMA)).collect() == []


def test_normal_distribution(spark):
    import math

    for z in (-9.0, -5.5, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0):
        got = spark.range(1).select(ss._normal_below(F.lit(z)).alias("p")).first().p
        assert abs(got - 0.5 * math.erfc(-z / 2**0.5)) < 2e-7
