"""MinHash near-duplicates: BagMinHash signatures of weighted word shingles, banding, exact multiset verification.

A text is the multiset of its 5-word shingles. The weights of a shingle are cut into dyadic levels [0, 1), [1, 2),
[2, 4), [4, 8) ...; each level of each shingle carries a Poisson process whose points have a time, a signature component
and a weight within the level, all drawn from a seed fixed by shingle and level. A text accepts the points under its own
weight, and a component keeps the accepted point that comes first. Two texts then agree in a component with probability
of their weighted Jaccard similarity. Points are drawn in order of time up to a limit that fills all components with
high probability; where one stays empty the limit is doubled, so signatures never depend on it.

Exact copies become one node first. All nodes of a band bucket are compared with the bucket's least node and components
are formed. In buckets of very many nodes, nodes outside the largest component are compared with one of its nodes, a few
times over. What is then still in several components is settled exactly: a bucket's nodes outside its largest component
meet all its nodes in groups of bounded size, a large bucket being dealt into parts and every part meeting every other
one. A group's task compares multisets there and then, skips pairs that are in one component or that an earlier shared
bucket compares, and gives out links alone, never pairs. So no candidate link between classes is lost.
With 30 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability 7e-6.

Defined cases: a text of fewer than 5 words is one shingle of all its words; null, empty and wordless texts are one
class; class_id is the least doc_id of the class (null if it has none); repeated rows are copies; long texts are taken
whole; other columns, whatever their names, are ignored by `classes` and kept by `deduplicate`, which takes the row of least
hash among those of equal id and text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quillbase.llm.common import GOLDEN, U64, WordIds, documents, kept, map_arrow, mix, own_columns, quoted, runs, staged, text_blocks, text_or_empty, whole_row, width

WORDS = 5
BANDS, ROWS = 30, 5
#: Similarity as a fraction, so that verification is in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Members of one comparing group; a leader of more is handed out again.
GROUP = 1000
#: Turns in which the small components of a bucket of over GROUP nodes meet one node of its largest.
STARS = 3
#: Elements on either side of a comparing group, on average; either side has about GROUP nodes at most.
SIDE = 400_000
BLOCK = 1 << 20
#: Edges (of 16 bytes) that one task links up; more of them take rounds of stars.
ALONE = 1 << 20
_words = kept(WordIds())


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of every distinct shingle of each text, in order of row, then shingle."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    flat = _words.hashes([w for s in split for w in s])
    begin = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(len(texts)), np.maximum(sizes - words + 1, 0))
    value = np.zeros(0, U64)
    if len(flat) >= words:
        n = len(flat) - words + 1
        every = np.zeros(n, U64)
        for i in range(words):
            every = mix(every + flat[i : i + n] + GOLDEN)
        long = sizes >= words
        value = every[np.concatenate([np.arange(b, b + s - words + 1) for b, s in zip(begin[long], sizes[long], strict=True)])] if long.any() else value
    short = np.flatnonzero(sizes < words)
    whole = np.zeros(len(short), U64)
    for i in range(words - 1):
        has = sizes[short] > i
        whole[has] = mix(whole[has] + flat[begin[short[has]] + i] + U64(1))
    rows, value = np.concatenate([rows, short]), np.concatenate([value, mix(whole + U64(7))])
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])])
    return rows[first], value[first], np.diff(np.r_[first, len(rows)])


def signatures(n: int, rows: np.ndarray, items: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signatures, n x m ids of points; every row has an item."""
    total = np.bincount(rows, weights, n)
    out = np.zeros((n, m), U64)
    todo, reach = np.arange(n), m * (np.log(m) + 5)
    while len(todo):
        here = np.full(n, -1)
        here[todo] = np.arange(len(todo))
        mine = here[rows] >= 0
        got, times = _first_points(len(todo), here[rows[mine]], items[mine], weights[mine], reach / total[todo], m)
        full = np.isfinite(times).all(1)
        out[todo[full]] = got[full]
        todo, reach = todo[~full], reach * 2
    return out


def _first_points(n: int, rows: np.ndarray, items: np.ndarray, weights: np.ndarray, limit: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1  # 1: [0, 1); 2: and [1, 2); 3: and [2, 4) ...
    row, item, weight = (np.repeat(x, levels) for x in (rows, items, weights))
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    floor = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    span = np.maximum(floor, 1)
    seed = mix(item + level.astype(U64) * M_LEVEL)
    time, end = np.zeros(len(row)), limit[row]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        seed = mix(seed + GOLDEN)
        time = time - np.log(((seed >> U64(11)).astype(float) + 0.5) * 2.0**-53) / span
        keep = time <= end
        row, weight, floor, span, seed, time, end = (x[keep] for x in (row, weight, floor, span, seed, time, end))
        point = mix(seed ^ M_POINT)
        under = floor + ((point & U64(0xFFFFFFFF)).astype(np.int64) * span >> 32) < weight
        component = ((point >> U64(32)).astype(np.int64) * m) >> 32
        found.append(((row * m + component)[under], time[under], point[under]))
    where, when, which = (np.concatenate(x) for x in zip(*found, strict=True))
    times, ids = np.full(n * m, np.inf), np.zeros(n * m, U64)
    np.minimum.at(times, where, when)
    first = when == times[where]
    ids[where[first]] = which[first]
    return ids.reshape(n, m), times.reshape(n, m)


M_LEVEL, M_POINT = U64(0xD1B54A32D192ED03), U64(0xA0761D6478BD642F)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=U64), (len(signature), 1))
    cube = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        out = mix(out * GOLDEN + cube[:, :, i])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of equal texts), n (shingles) and bands of every document."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        sizes, bands = [], []
        for i, j in runs([len(t) + 2000 for t in texts], BLOCK):
            rows, items, counts = shingles(texts[i:j])
            sizes.append(np.bincount(rows, counts, j - i).astype(np.int64))
            bands.append(band_hashes(signatures(j - i, rows, items, counts, BANDS * ROWS)))
        hashes = np.concatenate(bands)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, BANDS), pa.int32()), pa.array(hashes.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(np.concatenate(sizes)), lists], names=["doc_id", "key", "n", "bands"])

    text = text_or_empty()
    rows = docs.select("doc_id", _key(text).alias("key"), text.alias("text"))
    return map_arrow(rows, of_batch, "doc_id long, key binary, n long, bands array<long>")


def _key(text: Column) -> Column:
    """16 bytes that equal texts share."""
    return F.unhex(F.md5(text))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the least and of the greatest counts of two sorted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least, int(a[1].sum() + b[1].sum()) - least


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, part, node, text) in that order, a part's leader (node null) first -> linked (node, leader)."""
    now, held = None, None
    for batch in batches:
        texts = batch.column("text").to_pylist()
        heads = list(zip(*(batch.column(c).to_pylist() for c in ("leader", "part", "node")), strict=True))
        out = []
        for i, j in runs([len(t) for t in texts], BLOCK):
            rows, items, counts = shingles(texts[i:j])
            bounds = np.searchsorted(rows, np.arange(j - i + 1))
            for k in range(i, j):
                own = slice(bounds[k - i], bounds[k - i + 1])
                leader, part, node = heads[k]
                if node is None:
                    now, held = (leader, part), (items[own], counts[own])
                    continue
                if now != (leader, part):
                    raise ValueError("a group came without its leader")
                least, most = overlap(held, (items[own], counts[own]))
                if least * DENOMINATOR >= most * NUMERATOR:
                    out.append((node, leader))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those whose multisets overlap enough; texts: (node, text), one row for each node.

    Pairs are grouped under their leader b, and a leader of many is dealt to several groups of GROUP members.
    """
    leaders = staged(pairs.groupBy("b").agg(F.count("*").alias("members")).select(F.col("b").alias("leader"), F.ceil(F.col("members") / GROUP).alias("parts")), "leaders")
    heads = leaders.join(texts, leaders["leader"] == texts["node"]).select("leader", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    members = pairs.join(leaders, pairs["b"] == leaders["leader"]).select("a", "leader", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    members = members.join(texts, members["a"] == texts["node"]).select("leader", "part", F.col("a").alias("node"), "text")
    rows = heads.select("leader", "part", F.lit(None).cast("long").alias("node"), "text").unionByName(members)
    dealt = rows.repartition(width(pairs.sparkSession), "leader", "part").sortWithinPartitions("leader", "part", "node")  # nulls first
    return dealt.mapInArrow(_compare, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) but the least of each component, with that least one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[apart := x != y], y[apart]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> stars with the same components, one set of them for every ALONE rows or so."""

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = _forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(x.num_rows for x in held) + batch.num_rows > ALONE:
            yield solved(held)
            held = []
        held.append(batch)
    if held:
        yield solved(held)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked component.

    Each task first turns its own edges into stars. Where ALONE edges at most are left, one task ends the work; else
    alternating large and small stars go on, each a minimum for each node and a join, until that is so or a step changes no
    edge. The minima are written out before they are joined, as AQE splits a star's hot centre only where both sides are
    plain shuffles.
    """
    edges = staged(links.where("a <> b").select("a", "b").mapInArrow(_forests, "a long, b long"), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
        if mark == seen or mark["n"] <= ALONE:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = staged(small.where("a <> b").distinct(), "edges")
    if mark["n"] <= ALONE:
        edges = staged(edges.repartition(1).mapInArrow(_forests, "a long, b long"), "roots")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _near_in_size() -> Column:
    return (F.least("n", "m") * DENOMINATOR >= F.greatest("n", "m") * NUMERATOR)


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, band, node, n, size, root, top) of the buckets that hold several components; top is the largest one's root."""
    labelled = buckets.join(roots, "node", "left").select("bucket", "band", "node", "n", "size", F.coalesce("root", "node").alias("root"))
    sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("bucket", F.col("top.root").alias("top"))
    return staged(labelled.join(staged(largest, "largest"), "bucket"), "open")


def _star_pairs(open_: DataFrame, turn: int) -> DataFrame:
    """Nodes outside a bucket's largest component, each with one node of that component, another one for each bucket and turn."""
    order = F.xxhash64("node", "bucket", F.lit(turn))
    leader = open_.where("root = top").groupBy("bucket").agg(F.min_by(F.struct("node", "n"), order).alias("l")).select("bucket", F.col("l.node").alias("leader"), F.col("l.n").alias("m"))
    met = open_.where("root <> top").join(staged(leader, "leader"), "bucket").where(_near_in_size())
    return met.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()


def _elements(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, elements): sorted 64-bit hashes of each node's shingles with the number of their occurrence, so that multisets become sets."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, texts in text_blocks(batch.column("text"), BLOCK):
            rows, items, counts = shingles(texts.to_pylist())
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            row, value = np.repeat(rows, counts), mix(np.repeat(items, counts) + nth.astype(U64) * M_LEVEL)
            value = value[np.lexsort((value, row))]
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            out += [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "elements"])

    return map_arrow(nodes.join(texts, "node").select("node", "text"), of_batch, "node long, elements binary")


def _bits(which: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Rows of bits: bit which[j] of row i for bounds[i] <= j < bounds[i + 1]."""
    out = np.zeros((len(bounds) - 1, n // 64 + 1), U64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    np.bitwise_or.at(out, (row, which >> 6), U64(1) << (which & 63).astype(U64))
    return out


def _links(group: list[dict], band: int) -> list[tuple[int, int]]:
    """Similar pairs of a leader and a member that no earlier band compares and that no component holds."""
    leaders, members = [r for r in group if r["leads"]], [r for r in group if not r["leads"]]
    sets = [[np.frombuffer(r["elements"], U64) for r in side] for side in (leaders, members)]
    sizes = [np.array([len(e) for e in side], np.int64) for side in sets]
    every = np.unique(np.concatenate(sets[0]))
    flat = np.concatenate(sets[1])
    place = np.minimum(np.searchsorted(every, flat), len(every) - 1)
    shared = every[place] == flat
    bounds = np.concatenate([[0], np.cumsum(sizes[1])])
    held = _bits(place[shared], np.concatenate([[0], np.cumsum(shared)])[bounds], len(every))
    own = _bits(np.searchsorted(every, np.concatenate(sets[0])), np.concatenate([[0], np.cumsum(sizes[0])]), len(every))
    node, root = (np.array([r[k] for r in members]) for k in ("node", "root"))
    bands = np.array([r["bands"] for r in members], np.int64)
    out = []
    for i, r in enumerate(leaders):
        n = sizes[0][i]
        near = np.minimum(n, sizes[1]) * DENOMINATOR >= np.maximum(n, sizes[1]) * NUMERATOR
        at = np.flatnonzero(near & (root != r["root"]) & ~(bands[:, :band] == np.array(r["bands"][:band], np.int64)).any(1))
        for k in range(0, len(at), 256):
            some = at[k : k + 256]
            least = np.bitwise_count(held[some] & own[i]).sum(1, dtype=np.int64)
            alike = some[least * DENOMINATOR >= (n + sizes[1][some] - least) * NUMERATOR]
            out += [(r["node"], m) for m in node[alike].tolist()]
    return out


_GROUP = ("bucket", "band", "first", "second")
_MEMBER = ("leads", "node", "root", "bands", "elements")


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _GROUP and _MEMBER in order of the group -> links (a, b)."""

    def solved(group: list[dict], band: int) -> pa.RecordBatch | None:
        found = _links(group, band) if any(r["leads"] for r in group) and not all(r["leads"] for r in group) else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"]) if found else None

    now, held = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in _GROUP), strict=True)
        for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in _MEMBER), strict=True):
            if key != now:
                if held and (out := solved(held, now[1])):  # type: ignore[index]
                    yield out
                now, held = key, []
            held.append(dict(zip(_MEMBER, row, strict=True)))
    if held and (out := solved(held, now[1])):  # type: ignore[index]
        yield out


def _settled(open_: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the components of open buckets: each node outside the largest component against all nodes."""
    wanted = open_.select("node").distinct()
    elements = staged(_elements(wanted, texts), "elements")
    held = elements.join(nodes.select("node", "bands"), "node")
    minor = F.col("root") != F.col("top")
    parts = lambda of: F.greatest(F.ceil(F.sum(F.when(of, F.col("n"))) / SIDE), F.ceil(F.count_if(of) / GROUP))
    sizes = open_.groupBy("bucket").agg(parts(minor).alias("lead_parts"), parts(F.lit(True)).alias("parts"))
    placed = open_.join(staged(sizes, "sizes"), "bucket")
    part = lambda of: F.pmod(F.xxhash64("node", "bucket"), F.col(of))
    upto = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    own = ["bucket", "band", "node", "root"]
    leaders = placed.where(minor).select(*own, part("lead_parts").alias("first"), upto("parts").alias("second"), F.lit(True).alias("leads"))
    members = placed.select(*own, upto("lead_parts").alias("first"), part("parts").alias("second"), F.lit(False).alias("leads"))
    rows = staged(leaders.unionByName(members), "dealt").join(held, "node").select(*_GROUP, *_MEMBER)
    n = width(open_.sparkSession)
    return rows.repartition(n, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_compare_groups, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, root and class_id of every row; the root tells classes apart where ids are null or repeat."""
    rows = staged(signed(docs), "signed")
    nodes = staged(rows.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    exploded = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = exploded.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("size")).where("size > 1")
    buckets = staged(exploded.join(staged(shared, "shared"), "bucket").select("bucket", "band", "node", "n", "size", F.col("least.node").alias("leader"), F.col("least.n").alias("m")), "buckets")
    first = staged(buckets.where("node <> leader").where(_near_in_size()).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")

    involved = buckets.select("node").distinct()
    text = text_or_empty()
    keyed = docs.select(_key(text).alias("key"), text.alias("text"))
    wanted = nodes.join(involved, "node").select("key", "node")
    texts = staged(keyed.join(wanted, "key").select("node", "text").dropDuplicates(["node"]), "texts")

    roots = components(staged(verified(first, texts), "links"))
    large = buckets.where(F.col("size") > GROUP)
    for turn in range(STARS if large.limit(1).count() else 0):
        open_ = _open(large, roots)
        found = staged(verified(staged(_star_pairs(open_, turn), "pairs"), texts), "links")
        if not found.limit(1).count():
            break
        roots = components(_edges(roots).unionByName(found))
    open_ = _open(buckets, roots)
    if open_.limit(1).count():
        found = staged(_settled(open_, nodes, texts), "links")
        if found.limit(1).count():
            roots = components(_edges(roots).unionByName(found))
    named = nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    placed = staged(rows.select("doc_id", "key").join(named, "key"), "placed")
    least = staged(placed.groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    return placed.join(least, "root").select("doc_id", "key", "root", "class_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, that of its least doc_id (a null id counts as the largest), with all its columns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    chosen = staged(classes(docs).groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key")), "chosen")
    plain = [F.col(quoted(f.name)) for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    keyed = docs.select(whole_row(docs), F.col("doc_id").alias("_own_id"), _key(text_or_empty()).alias("_own_key"), F.xxhash64(*plain).alias("_order"))
    kept = keyed.join(chosen, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_key") == F.col("_key")))
    one = kept.groupBy("_id", "_key").agg(F.min_by("_row", "_order").alias("_row"))
    return one.select(*own_columns(docs.columns))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return deduplicate(docs)
