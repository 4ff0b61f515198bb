"""Groups of documents whose sets of word n-grams have a Jaccard similarity of at least a given fraction.

Exact over 64-bit fingerprints of n-grams:

1. One pass counts words in a table of fixed size.  It only fixes a global order of n-grams, those of rare
   words first, so that n-grams of common words and of widespread passages come last.
2. A second pass turns each text into its set: size, a fingerprint of the whole set and, in that order,
   the prefix that any partner has to share.  Equal sets become one *class*.
3. Classes that share a prefix n-gram are compared by their bitmaps alone, but for those that, by sizes and
   places of the n-gram in the order, fit none of the others under it; those that may
   link are joined to stars, never to all pairs, and the components are *clusters*.  No link crosses
   clusters.  Under an n-gram of very many classes, those of one size band are joined to a star, and the
   stars of neighbouring bands to each other, without a look at the bitmaps.
4. The sets of each cluster meet in size-banded tiles: bands of the similarity's ratio, so that links
   stay within a band or reach the next one, and blocks of bounded size within a band.  In a tile,
   bit counts of hashed bitmaps bound the overlap from above; pairs that pass are decided by
   intersecting the sorted arrays.  Pairs whose classes are joined already are not looked at again.
   A cluster of many sets first meets a few heads of each band; what links with them makes its core,
   and only the sets outside the core then meet all others.  So a group of near copies that fills a
   cluster is read a few times, however large, and no pair goes undecided.
5. A tile gives a spanning star of each local component; their components are the result.

Cases: null or blank texts have an empty set and no links; repeated rows link with each other; a null id
is larger than none, so it never names a component unless all of its ids are null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.components import connected
from gneiss.llm.rolling import mix
from gneiss.llm.work import drop_written, packed, take, text_pieces, tidied, unpacked, written
from gneiss.llm.words import fingerprints, shingles

PIECE = 1 << 20
#: Cells of the table of approximate word counts; it is broadcast as one byte a cell.
CELLS = 1 << 20
#: Rows of that table that are summed together.
_BLOCK = 1 << 12
#: Sets and n-grams in one block of a tile.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 22
#: Bits of the smallest bitmap; larger sets have the next power of two above their size.
BITS = 1024
#: Classes under one prefix n-gram up to which their bitmaps are compared before the tiles.
CROWD = 2048
#: Classes under one prefix n-gram up to which those that fit no other leave before bitmaps are fetched.
FEW = 64
#: Heads of a size band of a large cluster.
HEADS = 8


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
        row, word = fingerprints(raw, at)
        grams, bounds = shingles(row, word, stop - first, k)
        yield first, stop, grams, bounds


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def cell_ranks(texts: DataFrame) -> np.ndarray:
    """For each cell four times the binary logarithm of its count over all texts: ``CELLS`` bytes, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, raw, at in text_pieces(batch.column("text"), PIECE):
                total += np.bincount(_cell(fingerprints(raw, at)[1]), minlength=CELLS)
        rows = total.reshape(-1, _BLOCK)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.astype(np.uint32).tobytes() if x.max() < 1 << 32 else np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in rows[some]], pa.binary())], names=["block", "counts"])

    def add(key, pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(x, dtype=np.uint32).astype(np.float64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"block": [key[0]], "ranks": [np.ceil(4 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    parts = texts.mapInArrow(tidied(count), "block int, counts binary")
    out = np.zeros((CELLS // _BLOCK, _BLOCK), dtype=np.uint8)
    for r in parts.groupBy("block").applyInPandas(add, "block int, ranks binary").collect():
        out[r["block"]] = np.frombuffer(r["ranks"], dtype=np.uint8)
    return out.ravel()


def required(n: int, m: int, num: int, den: int) -> int:
    """Smallest overlap of sets of n and m members with ``den * overlap >= num * union``."""
    return -(-num * (n + m) // (num + den))


def _signature_batches(k: int, num: int, den: int, ranks, id_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ranks.value
        for batch in batches:
            for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                row, word = fingerprints(raw, at)
                grams, bounds, weight = shingles(row, word, stop - first, k, order[_cell(word)].astype(np.int64))
                sizes, one, two, heads, maps = [], [], [], [], []
                for i in range(stop - first):
                    own, where = np.unique(grams[bounds[i] : bounds[i + 1]], return_index=True)
                    n = len(own)
                    sizes.append(n)
                    maps.append(bitmap(own).tobytes())
                    one.append(mix(np.add.reduce(mix(own ^ np.uint64(0x1234567)), dtype=np.uint64) + np.uint64(n)))
                    two.append(np.add.reduce(mix(own + np.uint64(0x9876543)), dtype=np.uint64))
                    rank = np.minimum(weight[bounds[i] : bounds[i + 1]][where], 1023).astype(np.uint64)
                    keys = (rank << np.uint64(54)) | (own >> np.uint64(10))
                    size = n - -(-num * n // den) + 1 if n else 0
                    heads.append(np.sort(np.partition(keys, size - 1)[:size] if size else keys).view(np.int64))
                rows = np.arange(first, stop)
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "id", rows), take(batch, "text_key", rows), pa.array(sizes, pa.int32()), pa.array(np.array(one, dtype=np.uint64).view(np.int64)), pa.array(np.array(two, dtype=np.uint64).view(np.int64)), pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    names=["id", "text_key", "n", "node", "two", "head", "bitmap"],
                )

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("two", T.LongType()), T.StructField("head", T.ArrayType(T.LongType())), T.StructField("bitmap", T.BinaryType())])
    return run, schema


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, grams, bounds in _sets(batch, k):
                rows = np.arange(first, stop)
                sets = [np.unique(grams[bounds[i] : bounds[i + 1]]).tobytes() for i in range(stop - first)]
                yield pa.RecordBatch.from_arrays([take(batch, "cluster", rows), take(batch, "node", rows), pa.array(sets, pa.binary())], names=["cluster", "node", "grams"])

    return run, "cluster long, node long, grams binary"


def bitmap(own: np.ndarray) -> np.ndarray:
    """A power of two of bits, ``BITS`` and the set's size at least, with those set to which members hash."""
    size = max(BITS, 1 << max(len(own) - 1, 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(own >> np.uint64(20)) % np.uint64(size)] = 1
    return np.packbits(bits).view(np.uint64)


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def link(size: np.ndarray, maps: list[np.ndarray], side: np.ndarray, num: int, den: int, decide=None) -> Forest:
    """Joins sets, sorted by size, that may link by their bitmaps and that ``decide(i, j)`` confirms.

    With two sides only pairs across them are compared; pairs that are joined already are not.  A bitmap
    is folded to the width of a smaller partner's.
    """
    width = np.array([len(x) for x in maps])
    first = np.concatenate(([0], np.flatnonzero(width[1:] != width[:-1]) + 1))
    stack = [np.stack(maps[a:b]) for a, b in zip(first, [*first[1:], len(maps)], strict=True)]
    ones = np.concatenate([np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in stack])
    two = len(np.unique(side)) > 1
    out = Forest(len(size))
    label = np.arange(len(size))
    for i in range(1, len(size)):
        low = int(np.searchsorted(size, -(-num * size[i] // den)))
        if low >= i:
            continue
        fit = low + np.flatnonzero((label[low:i] != label[i]) & ((side[low:i] != side[i]) | (not two)))
        own, own_ones = maps[i], ones[i]
        for k in range(len(first) - 1, -1, -1):
            js = fit[(fit >= first[k]) & (fit < first[k] + len(stack[k]))]
            if not len(js):
                continue
            while len(own) > stack[k].shape[1]:
                own = own[: len(own) // 2] | own[len(own) // 2 :]
                own_ones = int(np.bitwise_count(own).sum())
            common = np.bitwise_count(stack[k][js - first[k]] & own).sum(axis=1, dtype=np.int64)
            most = np.minimum(size[i] - (own_ones - common), size[js] - (ones[js] - common))
            need = -(-num * (size[i] + size[js]) // (num + den))
            for j in js[most >= need]:
                if label[j] != label[i] and (decide is None or decide(i, j)):
                    out.join(i, int(j))
                    label[label == label[j]] = label[i]
    return out


def link_tile(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning star, as index pairs, of each group of sets that link."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    ranked = [sets[i] for i in order]

    def decide(i: int, j: int) -> bool:
        a, b = ranked[i], ranked[j]
        spot = np.searchsorted(b, a)
        spot[spot == len(b)] = 0
        return int((b[spot] == a).sum()) >= required(len(a), len(b), num, den)

    found = link(np.array([len(x) for x in ranked], dtype=np.int64), [bitmap(x) for x in ranked], side[order], num, den, decide)
    return [(int(order[i]), int(order[found.root(i)])) for i in range(len(ranked)) if found.root(i) != i]


def _tile_batches(num: int, den: int):
    """Rows come sorted by cluster and tile; each tile is held whole, and blocks bound its size."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        nodes = [r[0] for r in rows]
        pairs = [(nodes[i], nodes[j]) for i, j in link_tile([np.frombuffer(r[2], dtype=np.uint64) for r in rows], np.array([r[1] for r in rows]), num, den)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]) if pairs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(x) for x in ("cluster", "tile", "node", "side", "grams")]
            for i in range(batch.num_rows):
                now = (columns[0][i].as_py(), columns[1][i].as_py())
                if now != key:
                    if len(held) > 1 and (out := solve(held)) is not None:
                        yield out
                    key, held = now, []
                held.append((columns[2][i].as_py(), columns[3][i].as_py(), columns[4][i].as_buffer().to_pybytes()))
        if len(held) > 1 and (out := solve(held)) is not None:
            yield out

    return run


def _band(n: Column, num: int, den: int) -> Column:
    """Size bands: sets that link are of one band or of neighbouring ones."""
    ratio = math.log(den / num) if num < den else 1.0
    return F.floor(F.log(n) / ratio + 1e-9).cast("int")


def _blocks(n: Column) -> Column:
    """Blocks for sets of ``n`` members, so that two blocks make a tile of bounded size."""
    return F.greatest(F.ceil(F.count(n) / (BLOCK_SETS // 2)), F.ceil(F.coalesce(F.sum(n), F.lit(0)) / (BLOCK_GRAMS // 2))).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks).cast("long")).cast("int")


def _each(df: DataFrame, blocks: str) -> DataFrame:
    """A row ``i`` for each of a row's ``blocks``."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("i"))


def _bands_beside(df: DataFrame) -> DataFrame:
    """Each row once for its band and once for each of the two beside it, as ``other``."""
    return df.select("*", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("other"))


def _seats(df: DataFrame, side: int, *tile: str | Column) -> DataFrame:
    return df.select("cluster", F.concat_ws("/", *tile).alias("tile"), "node", F.lit(side).alias("side"), "grams")


def head_tiles(rows: DataFrame) -> DataFrame:
    """Tiles in which each set (``cluster``, ``band``, ``node``, ``n``, ``grams``) meets the heads of its band and of the two beside it."""
    bands = rows.groupBy("cluster", "band").agg(_blocks(F.col("n")).alias("blocks"))
    heads = rows.groupBy("cluster", "band", F.pmod(F.xxhash64("node"), F.lit(HEADS)).alias("slot")).agg(F.min("node").alias("node"))
    heads = _bands_beside(heads.join(rows.select("node", "grams"), "node")).join(bands.withColumnRenamed("band", "other"), ["cluster", "other"])
    members = rows.join(bands, ["cluster", "band"])
    return _seats(_each(heads, "blocks"), 0, "other", "i").unionByName(_seats(members, 1, "band", _block("blocks")))


def rest_tiles(rows: DataFrame) -> DataFrame:
    """Tiles in which each set that is not of the ``core`` meets all sets of its band and of the two beside it."""
    bands = rows.groupBy("cluster", "band").agg(_blocks(F.col("n")).alias("high"), _blocks(F.when(~F.col("core"), F.col("n"))).alias("low"))
    beside = _bands_beside(bands).select("cluster", F.col("other").alias("band"), F.struct(F.col("band").alias("other"), F.col("high").alias("other_high"), F.col("low").alias("other_low")).alias("o"))
    plan = bands.join(beside.groupBy("cluster", "band").agg(F.collect_list("o").alias("beside")), ["cluster", "band"])
    met = rows.join(plan, ["cluster", "band"]).select("*", F.explode("beside").alias("o")).select("*", "o.*")
    one = _seats(_each(met.where(~F.col("core")), "other_high"), 0, "band", _block("low"), "other", "i")
    return one.unionByName(_seats(_each(met.where("other_low > 0"), "other_low"), 1, "other", "i", "band", _block("high")))


def linked_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Stars ``a``, ``b`` of sets (``cluster``, ``node``, ``grams``) that link, for all links within clusters.

    A cluster within the block bounds is one tile.
    """

    def met(tiles: DataFrame) -> DataFrame:
        return tiles.repartition("cluster", "tile").sortWithinPartitions("cluster", "tile").mapInArrow(tidied(_tile_batches(num, den)), "a long, b long")

    n = (F.octet_length("grams") / 8).cast("long")
    totals = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum(n).alias("grams_sum"))
    large = written(totals.where((F.col("members") > BLOCK_SETS) | (F.col("grams_sum") > BLOCK_GRAMS)).select("cluster"), "large")
    whole = lambda df: met(df.select("cluster", F.lit("").alias("tile"), "node", F.lit(0).alias("side"), "grams"))
    if large.isEmpty():
        return whole(sets)
    rows = sets.join(large, "cluster").select("cluster", _band(n, num, den).alias("band"), "node", n.alias("n"), "grams")
    stars = written(met(head_tiles(rows)), "stars")
    parts = rows.select("cluster", "band", "node", "n").join(connected(stars), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = written(parts, "parts")
    core = parts.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("members")).groupBy("cluster").agg(F.max(F.struct("members", "component")).alias("most"))
    parts = parts.join(core, "cluster").select("node", (F.col("component") == F.col("most.component")).alias("core"))
    rest = met(rest_tiles(rows.join(parts, "node")))
    return whole(sets.join(large, "cluster", "left_anti")).unionByName(stars).unionByName(rest)


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each input row: id, ``text_key``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    ``keeper`` holds the id and text key of the row that stands for the component.  Two rows link when
    ``den * |intersection| >= num * |union|`` of their sets of ``k``-word n-grams.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must lie above 0 and not above 1")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    ranks = spark.sparkContext.broadcast(cell_ranks(base.select("text")))
    run, schema = _signature_batches(k, num, den, ranks, base.schema["id"].dataType)
    found = written(base.mapInArrow(tidied(run), schema), "signatures")

    member = F.struct(F.col("id").isNull().alias("no"), "id", "text_key")
    classes = written(found.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first("bitmap").alias("bitmap"), F.min(member).alias("member")), "classes")
    # Rows need neither prefixes nor bitmaps later: the table that holds them goes at once.
    members = written(found.select("id", "text_key", "n", "node"), "members")
    drop_written(found)
    links, posts = _candidates(classes, num, den)
    clusters = written(connected(links).select("node", F.col("component").alias("cluster")), "clusters")
    drop_written(posts)
    asked = clusters.join(classes.select("node", "member"), "node").select("cluster", "node", "member.id", "member.text_key")
    texts = base.dropDuplicates(["id", "text_key"]) if _repeats(members) else base
    texts = texts.alias("b").join(asked.alias("a"), F.col("b.id").eqNullSafe(F.col("a.id")) & (F.col("b.text_key") == F.col("a.text_key"))).select("a.cluster", "a.node", "b.text")
    run, schema = _set_batches(k)
    sets = written(texts.mapInArrow(tidied(run), schema), "sets")
    grouped = written(connected(linked_sets(sets, num, den)), "groups")
    drop_written(sets)

    best = classes.select("node", "member").join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "member")
    heads = best.groupBy("component").agg(F.min("member").alias("keeper"))
    named = written(best.join(heads, "component").select("node", "keeper"), "named")
    drop_written(classes)
    own = F.struct("id", "text_key")
    out = members.where("n > 0").join(named, "node").select("id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.struct("keeper.id", "keeper.text_key").alias("keeper"))
    alone = members.where("n = 0").select("id", "text_key", F.lit(0).cast("long").alias("n_shingles"), own.alias("keeper"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "text_key", "n_shingles", F.col("keeper.id").alias("component_id"), "keeper")


def _repeats(found: DataFrame) -> bool:
    """Whether any id and text come twice."""
    return bool(found.groupBy("id", "text_key").count().where("count > 1").limit(1).count())


def _candidates(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Stars over classes that share a prefix n-gram and whose sizes and bitmaps allow a link; the table that they are made of."""
    posts = classes.select("node", "n", F.posexplode("head").alias("at", "key")).select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    # Counted with a partial step and joined as plain exchanges, so the rows of a hot key are never in one task.
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    posts = written(posts.join(sizes, "key"), "posts")

    hot = posts.where(F.col("size") > CROWD).select("key", _band(F.col("n"), num, den).alias("band"), "node")
    firsts = hot.groupBy("key", "band").agg(F.min("node").alias("first"))
    stars = hot.join(firsts, ["key", "band"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    above = firsts.select("key", (F.col("band") - 1).alias("band"), F.col("first").alias("above"))
    steps = firsts.join(above, ["key", "band"]).where("above <> first").select(F.col("above").alias("a"), F.col("first").alias("b"))
    crowded = stars.unionByName(steps)

    lists = fitting(posts.where(F.col("size") <= CROWD), num, den)
    seats = lists.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("node"))
    seats = seats.join(classes.select("node", "n", "bitmap"), "node").repartition("list").sortWithinPartitions("list", "n", "node")
    return crowded.unionByName(seats.mapInArrow(tidied(_bitmap_batches(num, den)), "a long, b long")).distinct(), posts


def fitting(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Different lists ``nodes`` of classes that share a prefix n-gram, without those that fit none of the others.

    ``rest`` counts the members of a set from the n-gram on, in the order.  If it is the first that two sets share,
    the smaller rest bounds their overlap.  Of the n-grams with one list of classes the first in the order counts,
    the one with the largest rests: it is the first shared one of any two that do not meet in another list before.
    """
    seats = F.sort_array(F.collect_list(F.struct("node", "n", "rest"))).alias("seats")
    lists = posts.groupBy("key").agg(seats).groupBy(F.col("seats.node").alias("all")).agg(F.max("seats").alias("seats"))
    fit = lambda x, y: (x["node"] != y["node"]) & (F.least(x["rest"], y["rest"]).cast("long") * (num + den) >= (x["n"].cast("long") + y["n"]) * num)
    some = F.filter("seats", lambda x: F.exists("seats", lambda y: fit(x, y)))
    nodes = F.when(F.size("seats") <= FEW, F.transform(some, lambda x: x["node"])).otherwise(F.col("all"))
    return lists.select(nodes.alias("nodes")).where(F.size("nodes") > 1).distinct()


def _bitmap_batches(num: int, den: int):
    """Rows come sorted by list and size."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes, size = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        maps = [m for x in held for m in x[2]]
        found = link(size, maps, np.zeros(len(size)), num, den)
        root = np.array([found.root(i) for i in range(len(size))])
        some = np.flatnonzero(root != np.arange(len(root)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            lists = batch.column("list").to_numpy()
            nodes, size = batch.column("node").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            maps = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("bitmap").to_pylist()]
            cut = np.concatenate(([0], np.flatnonzero(lists[1:] != lists[:-1]) + 1, [len(lists)]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if held and lists[a] != key:
                    yield from solve(held)
                    held = []
                key = lists[a]
                held.append((nodes[a:b], size[a:b], maps[a:b]))
        if held:
            yield from solve(held)

    return run


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those that another row of their group stands for."""
    groups = jaccard_groups(docs, id_col=id_col, text_col=text_col, k=k, num=num, den=den)
    stay = groups.where(F.col(id_col).eqNullSafe(F.col("keeper.id")) & (F.col("text_key") == F.col("keeper.text_key"))).select(F.col(id_col).alias("stay_id"), F.col("text_key").alias("stay_key"), "n_shingles")
    stay = written(stay.groupBy("stay_id", "stay_key").agg(F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n")), "stay")
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_key"))
    out = rows.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_key") == F.col("stay_key")))
    if stay.where("copies > 1 and n > 0").limit(1).count():
        twice = out.where("copies > 1 and n > 0").dropDuplicates(["stay_id", "stay_key"])
        out = out.where("copies = 1 or n = 0").unionByName(twice)
    return out.select(*unpacked("row", docs.columns))
