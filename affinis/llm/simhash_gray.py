"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank, in which neighbours differ in few bits, and cut into parts of equal
count. A node above a run of fingerprints holds the bits that all of them share (mask, value). Two nodes can
hold links only if they differ in at most ``radius`` of the bits that both share, so a traversal of pairs
of nodes drops whole groups; what two nodes differ in only grows on the way down. The driver walks the
nodes of parts alone (one for each PART fingerprints); each surviving pair of parts is one group of a
grouped map, which walks the rest. A group returns a spanning forest of its links, so a group of copies
with very many links returns no more rows than it has fingerprints.

Defined results: a null or empty text has the fingerprint zero, which links like any other; equal texts
have equal fingerprints and share a component; ids may repeat; null ids order last and never name a
component unless all of its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.common import cut, full_text, ready_workers
from affinis.llm.components import connected_components
from affinis.llm.sharding import range_of

#: Contract of the fingerprint query.
SHINGLE_WORDS, RADIUS = 3, 2
#: Fingerprints in a part, and the children of a node.
PART, FAN = 1 << 17, 2
#: Pairs of nodes that are compared at once.
AT_ONCE = 1 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def _shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def _hashes(items: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(seed)), np.uint64, len(items))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """64 bits, from the XXH64 of each shingle of ``width`` words, repeats included."""
    return _majority(_hashes(_shingles(_words(text), width), seed))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, keep: list[str] | None = None, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc struct of the columns in ``keep``, id, fp long)."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _signed([fingerprint(t, width) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("id"), fps], ["doc", "id", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())]))


def gray_rank(fp: Column) -> Column:
    """The place of a code in Gray order, as a long that sorts as the unsigned rank."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _gray_rank(fps: np.ndarray) -> np.ndarray:
    for by in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(by))
    return fps


class GrayIndex:
    """Nodes over fingerprints in Gray order: on each level the bits that all below share, and those bits' values."""

    def __init__(self, masks: np.ndarray, values: np.ndarray) -> None:
        self.levels = [(masks, values)]
        while len(self.levels[-1][0]) > FAN:
            mask, value = self.levels[-1]
            n = -(-len(mask) // FAN)
            at = np.arange(n) * FAN
            # shared by all: shared by each child, with the same value
            ones = np.bitwise_and.reduceat(value, at)
            zeros = np.bitwise_and.reduceat(mask & ~value, at)
            self.levels.append((ones | zeros, ones))

    @classmethod
    def of(cls, fps: np.ndarray) -> GrayIndex:
        return cls(np.full(len(fps), ~np.uint64(0)), fps)


def walk(a: GrayIndex, b: GrayIndex, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of the lowest level of both whose shared bits differ in ``radius`` places at most."""
    if not len(a.levels[0][0]) or not len(b.levels[0][0]):
        return

    def near(up: int, over: int, i: np.ndarray, j: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        (ma, va), (mb, vb) = a.levels[up], b.levels[over]
        keep = np.bitwise_count((va[i] ^ vb[j]) & ma[i] & mb[j]) <= radius
        return up, over, i[keep], j[keep]

    up, over = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(len(a.levels[up][0])), np.arange(len(b.levels[over][0])), indexing="ij"))
    stack = [near(up, over, i, j)]
    step = max(1, AT_ONCE // (FAN * FAN))
    while stack:  # of pairs that are near; those of a level are opened a few at a time
        up, over, i, j = stack.pop()
        if up == 0 and over == 0:
            yield i, j
            continue
        if len(i) > step:
            stack.append((up, over, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        fan_a, fan_b = (FAN if up else 1), (FAN if over else 1)
        up, over = max(up - 1, 0), max(over - 1, 0)
        p = (i[:, None, None] * fan_a + np.arange(fan_a, dtype=np.int32)[None, :, None] + np.zeros(fan_b, np.int32)).ravel()
        q = (j[:, None, None] * fan_b + np.zeros(fan_a, np.int32)[:, None] + np.arange(fan_b, dtype=np.int32)[None, None, :]).ravel()
        there = (p < len(a.levels[up][0])) & (q < len(b.levels[over][0]))
        if len(p):
            stack.append(near(up, over, p[there], q[there]))


class Forest:
    """Union by smallest index, for arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            for _ in range(64):
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1) <= most


def local_links(fps: np.ndarray, side: np.ndarray, same: bool, radius: int, wide: np.ndarray | None = None, wide_radius: int = 0, band: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places in ``fps``) of the links between both sides, or within one if ``same``.

    With ``band``, links are between equal or neighbouring bands alone.
    """
    order = np.argsort(_gray_rank(fps), kind="stable")
    band = np.zeros(len(fps), np.int64) if band is None else band
    forest = Forest(len(fps))
    left = {x: order[(band[order] == x) & (same | (side[order] == 0))] for x in np.unique(band)}
    right = left if same else {x: order[(band[order] == x) & (side[order] == 1)] for x in np.unique(band)}
    index = {(k, x): GrayIndex.of(fps[places]) for k, places_of in enumerate((left, right)[: 1 if same else 2]) for x, places in places_of.items()}
    for x in left:
        for y in (x, x + 1) if same else (x - 1, x, x + 1):
            if y not in right:
                continue
            for i, j in walk(index[0, x], index[0 if same else 1, y], radius):
                if same and x == y:
                    i, j = i[i < j], j[i < j]
                i, j = left[x][i], right[y][j]
                if wide is not None:
                    sure = _near(wide[i], wide[j], wide_radius)
                    i, j = i[sure], j[sure]
                if len(i):
                    forest.join(i, j)
    forest.join(np.zeros(0, np.int64), np.zeros(0, np.int64))
    low = np.flatnonzero(forest.root != np.arange(len(fps)))
    return low, forest.root[low]


def links(nodes: DataFrame, radius: int, wide_radius: int | None = None, part: int = PART) -> DataFrame:
    """(a, b): a spanning forest of the links between the nodes (node long, fp long and, with ``wide_radius``, wide binary and band int).

    Parts are runs of Gray order, within runs of bands.
    """
    spark = nodes.sparkSession
    ready_workers(spark)
    if wide_radius is None:
        nodes = nodes.withColumn("band", F.lit(0))
    place = F.shiftleft(F.col("band").cast("long"), 56).bitwiseOR(F.shiftrightunsigned(gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63))), 8))
    ranked = cut(nodes.withColumn("rank", gray_rank(F.col("fp")) if wide_radius is None else place))
    n = ranked.count()
    parts = max(1, -(-n // part))
    splitters: list[int] = []
    if parts > 1:
        cuts = F.percentile_approx("rank", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(max(10_000, 40 * parts)))
        splitters = sorted(set(ranked.agg(cuts.alias("x")).first()["x"]))
    placed = ranked.withColumn("part", range_of(F.col("rank"), splitters).cast("int")).drop("rank")
    upper = sorted(map(tuple, placed.groupBy("part").agg(F.bit_and("fp"), F.bit_or("fp"), F.min("band"), F.max("band")).collect()))  # a row for each part
    ones = np.array([x[1] for x in upper], np.int64).view(np.uint64)
    some = np.array([x[2] for x in upper], np.int64).view(np.uint64)
    index = GrayIndex(~(ones ^ some), ones)
    pairs = []
    for i, j in walk(index, index, radius):
        pairs += [(upper[x][0], upper[y][0]) for x, y in zip(i, j) if x <= y and upper[y][3] - upper[x][4] <= 1 and upper[x][3] - upper[y][4] <= 1]
    rows = [(p, 0, k, int(p == q)) for k, (p, q) in enumerate(pairs)] + [(q, 1, k, 0) for k, (p, q) in enumerate(pairs) if p != q]
    if splitters:
        dealt = placed.join(spark.createDataFrame(rows, "part int, side int, pair int, same int"), "part")
    else:
        dealt = placed.select("*", *[F.lit(x).alias(c) for c, x in (("side", 0), ("pair", 0), ("same", 1))])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy(np.int64).view(np.uint64)
        wide = None
        if wide_radius is not None:
            wide = np.frombuffer(b"".join(group["wide"]), np.uint64).reshape(len(fps), -1)
        i, j = local_links(fps, group["side"].to_numpy(), bool(group["same"].max()), radius, wide, wide_radius or 0, group["band"].to_numpy(np.int64))
        node = group["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[i], "b": node[j]})

    columns = ["pair", "side", "same", "node", "fp", "band"] + (["wide"] if wide_radius is not None else [])
    return dealt.select(*columns).groupBy("pair").applyInPandas(run, "a long, b long")


def components(docs: DataFrame, keep: list[str] | None = None, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc struct of the columns in ``keep``, fp, component_id): each document with the smallest id that it reaches by links."""
    marked = cut(fingerprints(docs, keep, width))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    # components of one fingerprint have no row there
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc", "fp", "component_id")


#: Near-duplicates: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.
NEAR_WORDS, SIMILAR = 5, (4, 5)
#: Beside those of the index, candidates share a table's key, NEAR_ROWS minima of hashed shingles: a pair of similarity s meets in none of
#: the tables with a chance of (1 - s ** NEAR_ROWS) ** NEAR_TABLES, 3 in a million at 0.8, whatever the edits are.
NEAR_TABLES, NEAR_ROWS = 24, 4
#: A group that is compared holds about so many shingles; larger ones are cut into blocks, each pair of which is a group.
BLOCK = 1 << 21
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (NEAR_TABLES * NEAR_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of the different five-word shingles; the words themselves where there are fewer."""
    return np.unique(_hashes(_shingles(_words(text), NEAR_WORDS), 42))


def table_keys(grams: np.ndarray) -> np.ndarray:
    """A key for each table, of the least hashes of the shingles."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(grams), 1 << 12):
        least = np.minimum(least, (_FACTORS * grams[None, at : at + (1 << 12)]).min(1))
    least = least.reshape(NEAR_TABLES, NEAR_ROWS)
    keys = np.arange(1, NEAR_TABLES + 1, dtype=np.uint64)
    for k in range(NEAR_ROWS):
        keys = (keys ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _node() -> Column:
    return F.xxhash64(full_text())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, node, n, fp, keys): a hash of the text, its number of different shingles, its fingerprint of five-word shingles, and a key for each table."""
    ready_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _node().alias("node"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, keys = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = _hashes(_shingles(_words(text), NEAR_WORDS), 42)
                grams = np.unique(hashes)
                sizes.append(len(grams))
                fps.append(_majority(hashes))
                keys.append(table_keys(grams))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(sizes, pa.int32()), _signed(fps), _lists(keys)], ["id", "node", "n", "fp", "keys"])

    return rows.mapInArrow(run, "id long, node long, n int, fp long, keys array<long>")


def index_keys(nodes: DataFrame) -> DataFrame:
    """(node, n, key) from (node, n, fp): one key for all nodes whose fingerprints the Gray-order index links, directly or through others."""
    prints = cut(nodes.select("fp").distinct())
    found = connected_components(links(prints.select(F.col("fp").alias("node"), "fp"), RADIUS)).withColumnRenamed("node", "fp")
    component = F.coalesce("component", "fp")  # components of one fingerprint have no row there
    return nodes.join(found, "fp", "left").select("node", "n", F.xxhash64(F.lit("index"), component).alias("key"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, grams) of the texts in ``wanted`` (node)."""
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.where("doc_id IS NOT NULL").select(_node().alias("node"), "text").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, grams), pa.int32()), _lists(grams)], ["node", "n", "grams"])

    return texts.mapInArrow(run, "node long, n int, grams array<long>")


def _alike(common: Column | np.ndarray, total: Column | np.ndarray) -> Column | np.ndarray:
    """common / (total - common) >= SIMILAR, without a division; true of two empty sets."""
    return common * (SIMILAR[0] + SIMILAR[1]) >= total * SIMILAR[0]


def exact_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (places in ``sets``) of the similar pairs across labels, between both sides or within one if ``same``."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    root = np.unique(label, return_inverse=True)[1]
    here = np.zeros(len(vocabulary), np.int32)
    out_a, out_b = [], []
    for p in range(len(sets)):
        other = root != root[p]
        other &= (np.arange(len(sets)) > p) if same else (side != side[p]) & (side[p] == 0)
        other &= _alike(np.minimum(sizes, sizes[p]), sizes + sizes[p])
        if not other.any():
            continue
        here[flat[ends[p] - sizes[p] : ends[p]]] = 1
        found = np.flatnonzero(other)
        common = np.array([here[flat[ends[q] - sizes[q] : ends[q]]].sum() for q in found]) if len(found) < len(sets) // 8 else np.diff(np.concatenate([[0], np.cumsum(here[flat])])[np.concatenate([[0], ends])])[found]
        here[flat[ends[p] - sizes[p] : ends[p]]] = 0
        for q in found[_alike(common, sizes[found] + sizes[p])]:
            if root[q] != root[p]:
                out_a.append(p)
                out_b.append(q)
                root[root == root[q]] = root[p]
    return np.array(out_a, int), np.array(out_b, int)


def similar_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join all similar nodes that share a key. ``members``: (key, node, n, leader).

    First each node is compared with the leader of its keys, in rows as many as the members. Only keys whose nodes
    this leaves in several components are compared in full, across these, and keys of equal nodes once.
    """
    pairs = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
    total = F.col("na") + F.col("nb")
    alike = _alike(F.least("na", "nb"), total) & _alike(F.size(F.array_intersect("ga", "gb")), total)
    first = cut(pairs.join(a, "a").join(b, "b").where(alike).select("a", "b"))
    found = connected_components(first)
    labelled = members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    sums = [F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("nodes"), F.sum("n").alias("shingles")]
    # a key of two nodes has been compared in full
    unsettled = labelled.groupBy("key").agg(*sums).where("low < high AND rows > 2").groupBy("nodes", "rows", "shingles").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("shingles") / F.lit(BLOCK)).cast("int")
    dealt = labelled.drop("n").join(unsettled.select("key", F.greatest(blocks, F.lit(1)).alias("blocks")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y = exact_links([np.asarray(g, np.int64) for g in group["grams"]], group["label"].to_numpy(np.int64), group["side"].to_numpy(), bool((group["i"] == group["j"]).all()))
        node = group["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[x], "b": node[y]})

    rest = dealt.join(sets.select("node", "grams"), "node").groupBy("key", "i", "j").applyInPandas(run, "a long, b long")
    return first.unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(id, node, component_id) of each document, over near copies: five-word shingles of a similarity of 0.8 or more.

    Candidates are what the index over fingerprints links, as for the fingerprint query; pairs whose fingerprints differ in
    more bits, as those of 0.8 mostly do, are candidates by a shared key of a table. Each link is confirmed on both sets of
    shingles. Links are followed through, so a component can hold pairs of less. Nodes are hashes of texts; documents without
    an id link nothing.
    """
    signed = cut(signatures(docs))
    nodes = cut(signed.where("id IS NOT NULL").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys")]))
    rows = index_keys(nodes.select("node", "n", "fp")).unionByName(nodes.select("node", "n", F.explode("keys").alias("key")))
    shared = rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    members = cut(rows.join(shared, "key").select("key", "node", "n", "leader"))
    sets = cut(shingle_sets(docs, members.select("node").distinct()))
    found = connected_components(cut(similar_links(members, sets)))
    least = signed.where("id IS NOT NULL").groupBy("node").agg(F.min("id").alias("least")).join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "component").select("node", "component_id")
    return signed.select("id", "node").join(named, "node", "left").select("id", "node", "component_id")


#: Up to so many documents that go (16 MB of ids and nodes) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which no near copy has a smaller id; of rows with equal id and text, one.

    Different texts under one id are judged each by its own copies. Documents without an id are all kept: nothing
    says which of them would go.
    """
    near = cut(near_duplicates(docs))
    gone = near.where("id <> component_id").select(F.col("id").alias("__gone"), F.col("node").alias("__copy")).distinct()
    few = gone.count() <= BROADCAST_IDS
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("__id"), _node().alias("__node"))
    kept = rows.join(F.broadcast(gone) if few else gone, (F.col("__id") == F.col("__gone")) & (F.col("__node") == F.col("__copy")), "left_anti").select("doc.*")
    repeated = near.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
