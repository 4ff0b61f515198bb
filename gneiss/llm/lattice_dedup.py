"""Groups of vectors of one label with a cosine of at least a threshold, by hashing to the lattice E8.

1. Vectors that are equal in label and components become one *class* with a count.
2. Each table projects the unit vector on several sets of 8 random directions and decodes the nearest lattice point of each; the
   label, the table and the points are a bucket.  A vector also goes to the buckets of neighbouring points, those
   combinations that lie nearest of the neighbours of all sets.  Two sets are taken, or three if the caller asks for smaller
   buckets.  The size of the table decides nothing: the buckets of a vector, and so the pairs found, are the same in any.
3. Buckets of one class leave.  In the others cosines are checked and linked classes joined to stars.  In a bucket of many classes
   all are first compared with one of them; those that it does not link with are then compared with all, in blocks of
   bounded size.  So a bucket that one dense group fills takes few comparisons, and none is taken on trust.  The components are *clusters*.
4. In each cluster all pairs are checked, in blocks of bounded size, and links counted.

Links are pairs found: recall is measured in the tests.

Cases: vectors with a null label, and null, empty or zero vectors or such with null or non-finite components, have a row but
no links, like those with no partner; a null id keeps its row, and names no group that has another; repeated rows link with
each other; vectors of different lengths are not compared; an empty table gives an empty table; only the named
columns are read, so others may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import connected
from gneiss.llm.jaccard_join import Forest
from gneiss.llm.rolling import mix
from gneiss.llm.vectors import by_width, finite
from gneiss.llm.work import take, tidied, written

TABLES = 8
#: By sets of directions: buckets of a vector in each table, and how much finer than the projections the lattice is.
PROBING = {2: (6, 1.0), 3: (12, 0.8)}
#: Neighbours of a point that combinations are made of, itself included.
_NEAR = 4
#: Classes in a bucket up to which all are compared at once, and classes in a block of a cluster.
CROWD, BLOCK = 2048, 2048


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, of squared length 2."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    half = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(whole + half)


SHORTEST = _shortest()


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of the even-sum integer points and their copy shifted by a half."""

    def even(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        gap = x - near
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        worst = np.abs(gap[odd]).argmax(axis=1)
        near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
        return near

    a, b = even(y), even(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


@lru_cache(maxsize=8)
def directions(width: int, tables: int, codes: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([width, 8])).standard_normal((tables, codes, width, 8))


def buckets(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, codes: int = 2) -> np.ndarray:
    """Bucket fingerprints, one row for each vector with the same number of columns for each table."""
    out = []
    probes, scale = PROBING[codes]
    for t, sets in enumerate(directions(unit.shape[1], tables, codes)):
        h = mix(label.astype(np.uint64) * np.uint64(1000003) + np.uint64(t * 4096 + unit.shape[1]))[:, None]
        cost = np.zeros((len(unit), 1))
        for by in sets:
            y = scale * (unit @ by)
            point = decode(y)
            gain = (y - point) @ SHORTEST.T
            near = np.argpartition(-gain, _NEAR - 2, axis=1)[:, : _NEAR - 1]
            points = np.concatenate((point[:, None], point[:, None] + SHORTEST[near]), axis=1)
            # How much farther than the nearest point each is, squared.
            away = np.concatenate((np.zeros((len(y), 1)), 2 - 2 * np.take_along_axis(gain, near, axis=1)), axis=1)
            key = np.zeros(points.shape[:2], dtype=np.uint64)
            for axis in range(8):
                key = mix(key + np.rint(2 * points[:, :, axis]).astype(np.int64).view(np.uint64))
            h = mix(h[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + key[:, None]).reshape(len(unit), -1)
            cost = (cost[:, :, None] + away[:, None]).reshape(len(unit), -1)
        if h.shape[1] > probes:
            h = np.take_along_axis(h, np.argpartition(cost, probes - 1, axis=1)[:, :probes], axis=1)
        out.append(h)
    return np.concatenate(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucket_batches(tables: int, codes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_width(batch.column("vector")):
                for begin in range(0, len(rows), 2048):
                    own = rows[begin : begin + 2048]
                    keys = buckets(_unit(x[begin : begin + 2048]), batch.column("label_key").to_numpy()[own], tables, codes)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), take(batch, "node", np.repeat(own, keys.shape[1]))], names=["key", "node"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``names`` (whole numbers)."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if last is not None and tuple(keys[begin]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tuple(keys[begin])
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _edge_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _joined(close, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each joined row and the root of its star; ``close`` gives blocks of rows as (first row, matrix)."""
    found = Forest(n)
    for begin, linked in close:
        for i, j in zip(*np.nonzero(linked), strict=True):
            if j < begin + i:
                found.join(int(begin + i), int(j))
    root = np.array([found.root(i) for i in range(n)])
    some = np.flatnonzero(root != np.arange(n))
    return some, root[some]


def _star_batches(threshold: float, names: list[str]):
    """Stars of linked classes; with a column ``side`` only those of different sides are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, names):
            node, a, b = _numbers(rows, "node"), [], []
            side = _numbers(rows, "side") if "side" in rows.column_names else None
            for own, x in by_width(rows.column("vector")):
                unit = _unit(x)

                def close(unit=unit, own=own):
                    for begin in range(0, len(unit), 512):
                        linked = unit[begin : begin + 512] @ unit.T >= threshold
                        yield begin, linked if side is None else linked & (side[own[begin : begin + 512], None] != side[own])

                some, root = _joined(close(), len(unit))
                if len(some):
                    a.append(node[own[some]])
                    b.append(node[own[root]])
            if a:
                yield _edge_batch(a, b)

    return run


def _tile_batches(threshold: float):
    """``b`` null: ``links`` of node ``a`` found in a tile; else an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["cluster", "low", "high"]):
            across = rows.column("low")[0] != rows.column("high")[0]
            a, b, links = [], [], []
            every, label = _numbers(rows, "node"), _numbers(rows, "label_key")
            for own, x in by_width(rows.column("vector")):
                unit, node, kind = _unit(x), every[own], label[own]
                side, copies = _numbers(rows, "side")[own], _numbers(rows, "copies")[own].astype(np.float64)

                def close(unit=unit, side=side, kind=kind, node=node, copies=copies):
                    for begin in range(0, len(unit), 512):
                        end = min(begin + 512, len(unit))
                        linked = (unit[begin:end] @ unit.T >= threshold) & (kind[begin:end, None] == kind)
                        linked[np.arange(end - begin), np.arange(begin, end)] = False
                        if across:
                            linked &= side[begin:end, None] != side
                        n = linked @ copies
                        some = np.flatnonzero(n)
                        a.append(node[begin + some])
                        b.append(np.zeros(len(some), dtype=np.int64))
                        links.append(n[some].astype(np.int64))
                        yield begin, linked

                some, root = _joined(close(), len(unit))
                a.append(node[some])
                b.append(node[root])
                links.append(np.full(len(some), -1))
            number = np.concatenate(links)
            if len(number):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b), mask=number >= 0), pa.array(np.maximum(number, 0))], names=["a", "b", "links"])

    return run


def _crowded_edges(posts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Edges between linked classes of crowded buckets (``key``, ``node``)."""
    vectors = classes.select("node", "vector")
    heads = posts.groupBy("key").agg(F.min("node").alias("node")).join(vectors, "node").select("key", F.col("node").alias("head"), F.col("vector").alias("head_vector"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = dot(F.col("vector"), F.col("head_vector")) / F.sqrt(dot(F.col("vector"), F.col("vector"))) / F.sqrt(dot(F.col("head_vector"), F.col("head_vector")))
    same = F.size("vector") == F.size("head_vector")
    seats = posts.join(vectors, "node").join(heads, "key")
    seats = written(seats.select("key", "node", "head", "vector", F.coalesce(same & (cosine >= threshold), F.lit(False)).alias("linked")), "crowded")
    sizes = seats.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("high"), F.ceil(F.sum((~F.col("linked")).cast("int")) / CROWD).cast("int").alias("low")).where("low > 0")
    rows = seats.join(sizes, "key")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("not linked").select("key", block("low").alias("i"), blocks("high").alias("j"), F.lit(0).alias("side"), "node", "vector")
    right = rows.select("key", blocks("low").alias("i"), block("high").alias("j"), F.lit(1).alias("side"), "node", "vector")
    tiles = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = tiles.mapInArrow(tidied(_star_batches(threshold, ["key", "i", "j"])), "a long, b long")
    return seats.where("linked and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).unionByName(found.where("a <> b"))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = TABLES, codes: int = 2, many: int | None = None) -> DataFrame:
    """One row for each input row: id, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``.

    ``codes`` is the number of sets of directions.  ``many``, once the number of classes from which on it was three, has no effect.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(label_col).isNotNull()
    plain = vectors.select(F.col(id_col).alias("id"), F.xxhash64(F.col(label_col)).alias("label_key"), F.when(usable, F.transform(vector, lambda x: x + F.lit(0.0))).alias("vector"))
    plain = plain.withColumn("node", F.xxhash64("label_key", "vector"))
    good = plain.where("vector is not null")
    lowest = F.min(F.struct(F.col("id").isNull().alias("no"), "id"))
    classes = written(good.groupBy("node").agg(F.first("label_key").alias("label_key"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), lowest.alias("lowest")), "vectors")

    posts = classes.select("node", "label_key", "vector").mapInArrow(tidied(_bucket_batches(tables, codes)), "key long, node long")
    posts = written(posts.distinct(), "buckets")
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    posts = posts.join(sizes, "key")
    lists = posts.where(F.col("size") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    seats = lists.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("node")).join(classes.select("node", "vector"), "node")
    edges = seats.repartition("list").sortWithinPartitions("list").mapInArrow(tidied(_star_batches(threshold, ["list"])), "a long, b long")
    hubs = posts.where(F.col("size") > CROWD).select("key", "node")
    if not hubs.isEmpty():
        edges = edges.unionByName(_crowded_edges(hubs, classes, threshold))
    clusters = written(connected(edges).select("node", F.col("component").alias("cluster")), "clusters")

    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = clusters.join(blocks, "cluster").join(classes.select("node", "vector", "copies", "label_key"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high"), (F.col("block") > j).cast("int").alias("side")))
    tiles = rows.withColumn("t", F.explode(tile)).select("cluster", "t.low", "t.high", "t.side", "node", "label_key", "vector", "copies")
    checked = written(tiles.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high").mapInArrow(tidied(_tile_batches(threshold)), "a long, b long, links long"), "links")
    links = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = connected(checked.where("b is not null").select("a", "b"))

    best = classes.select("node", "copies", "lowest").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = best.groupBy("component").agg(F.min("lowest").alias("head"))
    named = best.join(heads, "component").join(links, "node", "left").select("node", F.col("head.id").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = good.select("id", "node").join(named, "node").select("id", "n_links", F.col("head").alias("component_id"))
    alone = plain.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
