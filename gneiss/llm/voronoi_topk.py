"""Exact top-k inner products by a Voronoi join.

1. Pivots, as many as the square root of the number of rows within ``PIVOTS``, are taken in the order of a hash of the ids.  Every vector goes
   to the cell of its nearest pivot of its length; where there is none, to that of the origin.  Cells are cut into shells
   by the distance from the pivot, larger cells into more.
2. A summary of each shell has its count, its least and largest distance and its largest norm; one of each cell its members' smallest
   distances from the pivot.  In these distances an id has one place over all cells of its length, however often it comes.
3. Each query is first solved against its own cell, whose k-th best score is a bar.  The smallest distances give another: a score that k + 1 ids
   reach at least, so k besides the query's own.
4. For a query q and a member x at distance d from pivot p, q.x is at most q.p + |q| d, and as |q - x| is at least the difference of |q - p| and d, at
   most (|q|^2 + |x|^2 - (|q - p| - d)^2) / 2.  Only shells whose bound reaches the higher bar get a copy of the query.
5. Shells are cut into blocks of bounded size, queries into groups; a block is copied to those groups alone that hold a query for
   it.  Each pair is solved exactly in one task, and the winners of all blocks are merged.

Cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part;
an id that comes twice counts once, with its best score, and is never its own candidate; vectors of different lengths are
not compared; ties go to the smaller id; an empty table gives an empty table; only the named columns are read, so others may clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.vectors import by_width, finite
from gneiss.llm.work import take, tidied, written

#: Least and largest number of pivots.
PIVOTS = (64, 4096)
#: Members of a block, queries of a group, shells of a cell at most and members that make a cell have one more.
BLOCK, QUERIES, SHELLS, SHELL = 8192, 8192, 16, 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)``, as whole numbers in double precision."""
    return np.floor(1024.0 * vectors)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exactly; beyond 64 bits they stay at its ends."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object).dot(np.array([[int(x) for x in row] for row in b], dtype=object).T)
    return np.array([[min(max(x, -(1 << 63)), (1 << 63) - 1) for x in row] for row in exact], dtype=np.int64)


class Pivots:
    """Pivots by vector length; cell numbers are unique over all lengths."""

    def __init__(self, rows: list[np.ndarray]):
        self.by_width: dict[int, tuple[int, np.ndarray]] = {}
        at = 0
        for d in sorted({len(r) for r in rows}):
            own = np.unique(np.stack([r for r in rows if len(r) == d]), axis=0)
            self.by_width[d] = (at, own)
            at += len(own)

    def of(self, d: int) -> tuple[int, np.ndarray]:
        return self.by_width.get(d, (-d, np.zeros((1, d))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, p = self.of(x.shape[1])
        best = np.zeros(len(x), dtype=np.int64)
        for i in range(0, len(x), 1024):
            best[i : i + 1024] = ((p * p).sum(axis=1) / 2 - x[i : i + 1024] @ p.T).argmin(axis=1)
        return best + first, np.sqrt(((x - p[best]) ** 2).sum(axis=1))


def _assign(pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in by_width(batch.column("vector")):
            x = scaled(x)
            cell, distance = pivots.value.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [take(batch, "id", rows), take(batch, "asks", rows), pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(np.sqrt((x * x).sum(axis=1))), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["id", "asks", "cell", "distance", "norm", "vector"],
            )


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            cells, distance = batch.column("cell").to_numpy(), batch.column("distance").to_numpy()
            for c in np.unique(cells):
                found[int(c)] = np.sort(np.concatenate((found.get(int(c), np.empty(0)), distance[cells == c])))[: k + 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["cell", "near"])

    return run


def guaranteed(q: np.ndarray, p: np.ndarray, near: list[np.ndarray], k: int) -> np.ndarray:
    """For each query (row) a score that k + 1 ids reach at least, by the smallest distances in each cell."""
    norm = np.sqrt((q * q).sum(axis=1))[:, None]
    at = q @ p.T
    size = max((len(x) for x in near), default=0)
    spread = np.full((len(near), size), np.inf)
    for j, x in enumerate(near):
        spread[j, : len(x)] = x
    sure = np.where(np.isfinite(spread), at[:, :, None] - norm[:, :, None] * np.where(np.isfinite(spread), spread, 0), -np.inf).reshape(len(q), -1)
    return -np.partition(-sure, k, axis=1)[:, k] if sure.shape[1] > k else np.full(len(q), -np.inf)


def bounds(q: np.ndarray, p: np.ndarray, least: np.ndarray, most: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query (row) and shell what no member's score exceeds; a shell has its pivot, its least and largest distance and its largest norm."""
    size = (q * q).sum(axis=1)[:, None]
    at = q @ p.T
    away = np.sqrt(np.maximum(size - 2 * at + (p * p).sum(axis=1), 0))
    gap = np.maximum(np.maximum(away - most, least - away), 0)
    root = np.sqrt(size)
    above = np.minimum(np.minimum(at + root * most, (size + norm**2 - gap**2) / 2), root * norm)
    return above + 1e-9 * (np.abs(at) + size + norm**2 + root * most + 1)


def _solve(k: int):
    def run(key, members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(asked):
            members = members.sort_values("id", kind="stable")
            ids = members["id"].to_numpy()
            x = np.stack([np.frombuffer(v, dtype=np.float64) for v in members["vector"]])
            for begin in range(0, len(asked), 256):
                part = asked.iloc[begin : begin + 256]
                score = inner(np.stack([np.frombuffer(v, dtype=np.float64) for v in part["vector"]]), x)
                for q, row in zip(part["query_id"].to_numpy(), score, strict=True):
                    some = np.flatnonzero(ids != q)
                    want = k
                    while True:  # more than k while rows of one id stand in each other's way
                        if len(some) > want:
                            bar = np.partition(row[some], len(some) - want)[len(some) - want]
                            top = some[row[some] >= bar]
                        else:
                            top = some
                        top = top[np.lexsort((ids[top], -row[top].astype(np.float64) if abs(row).max(initial=0) < 1 << 53 else [-int(v) for v in row[top]]))]
                        _, once = np.unique(ids[top], return_index=True)
                        if len(once) >= k or len(top) == len(some):
                            break
                        want *= 2
                    top = top[np.sort(once)][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": row[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_inner(vectors: DataFrame, asks: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int | None = None, looked_at: dict | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k largest scores of every row for which ``asks`` holds, over all other rows.

    ``looked_at`` gets the numbers of pairs of queries and rows that are compared and that there are.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    base = base.where(F.col("id").isNotNull() & finite(F.col("vector")))
    if pivots is None:
        pivots = min(max(PIVOTS[0], math.isqrt(base.count())), PIVOTS[1])
    chosen = base.orderBy(F.xxhash64("id"), "id", "vector").limit(pivots).select("vector").collect()
    shared = spark.sparkContext.broadcast(Pivots([scaled(np.array(r["vector"], dtype=np.float64)) for r in chosen]))
    rows = written(base.mapInArrow(tidied(lambda b: _assign(shared, b)), "id long, asks boolean, cell int, distance double, norm double, vector binary"), "cells")

    once = rows.groupBy("id", F.length("vector").alias("width")).agg(F.min(F.struct("distance", "cell")).alias("x")).select("x.cell", "x.distance")
    near = once.mapInArrow(tidied(_nearest(k)), "cell int, near array<double>").groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    steps = F.array(*[F.lit((i + 1) / SHELLS) for i in range(SHELLS - 1)])
    cut = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", steps, F.lit(1000)).alias("ends")).join(near, "cell", "left")
    cut = cut.select("cell", F.least(F.lit(SHELLS), F.ceil(F.col("n") / SHELL)).cast("int").alias("shells"), "ends", F.coalesce("near", F.array().cast("array<double>")).alias("near"))
    cells = {r["cell"]: r for r in cut.collect()}
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.expr(f"cast(size(filter(ends, e -> e < distance)) * shells div {SHELLS} as int)")
    shelled = rows.join(F.broadcast(spark.createDataFrame([(c, r["shells"], list(r["ends"])) for c, r in cells.items()], "cell int, shells int, ends array<double>")), "cell").withColumn("shell", place).drop("shells", "ends")
    shelled = written(shelled, "shells")
    of = shelled.groupBy("cell", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"), F.max("norm").alias("norm"))
    shells = [tuple(r) for r in of.orderBy("cell", "shell").collect()]
    summary = spark.sparkContext.broadcast((shells, {c: np.array(r["near"]) for c, r in cells.items()}))
    blocks = F.broadcast(spark.createDataFrame([(c, s, -(-n // BLOCK)) for c, s, n, *_ in shells], "cell int, shell int, blocks int"))
    members = shelled.join(blocks, ["cell", "shell"]).select("cell", "shell", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block"), "id", "vector")
    asked = shelled.where("asks").select(F.col("id").alias("query_id"), "cell", "vector")
    groups = max(1, -(-asked.count() // QUERIES))
    grouped = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    key = ["cell", "shell", "block", "group"]

    def solved(routed: DataFrame) -> DataFrame:
        """Best scores of the queries (``query_id``, ``cell``, ``shell``, ``vector``) in the shells they are sent to."""
        sent = written(routed.join(blocks, ["cell", "shell"]).select("cell", "shell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), grouped, "query_id", "vector"), "sent")
        wanted = sent.select(*[F.col(c).alias(f"to_{c}") for c in key]).distinct()
        copies = members.join(wanted, [F.col(c) == F.col(f"to_{c}") for c in key[:3]]).select(*key[:3], F.col("to_group").alias("group"), "id", "vector")
        if looked_at is not None:
            n = members.groupBy(*key[:3]).count().join(sent, key[:3]).agg(F.sum("count")).first()[0] or 0
            looked_at["pairs"] = looked_at.get("pairs", 0) + n
        found = copies.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, near = summary.value
        number = np.array([s[0] for s in every])
        for batch in batches:
            data = batch.column("vector").to_pylist()
            width = np.array([len(v) // 8 for v in data])
            own, bar = batch.column("cell").to_numpy(), batch.column("bar").to_numpy(zero_copy_only=False)
            for d in np.unique(width):
                rows = np.flatnonzero(width == d)
                first, p = shared.value.of(int(d))
                have = np.flatnonzero((number >= first) & (number < first + len(p)))
                pivot = p[number[have] - first]
                least, most, norm = (np.array([every[j][i] for j in have]) for i in (3, 4, 5))
                cells = np.unique(number[have])
                for begin in range(0, len(rows), 256):
                    some = rows[begin : begin + 256]
                    q = np.stack([np.frombuffer(data[i], dtype=np.float64) for i in some])
                    sure = guaranteed(q, p[cells - first], [near[c] for c in cells], k)
                    goal = np.fmax(bar[some].astype(np.float64), sure - 1e-9 * (np.abs(sure) + 1))
                    hit = (bounds(q, pivot, least, most, norm) >= goal[:, None]) & (number[have] != own[some][:, None])
                    asked, at = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays(
                        [take(batch, "query_id", some[asked]), pa.array(number[have[at]].astype(np.int32)), pa.array(np.array([every[j][1] for j in have[at]], dtype=np.int32)), take(batch, "vector", some[asked])],
                        names=["query_id", "cell", "shell", "vector"],
                    )

    here = asked.join(F.broadcast(spark.createDataFrame([s[:2] for s in shells], "cell int, shell int")), "cell").select("query_id", "cell", "shell", "vector")
    own = written(ranked(solved(here)), "own")
    bars = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bar"))
    routed = asked.join(bars, F.col("query_id") == F.col("id"), "left").select("query_id", "cell", "vector", "bar").mapInArrow(tidied(route), "query_id long, cell int, shell int, vector binary")
    # Rows of one query id may lie in several cells, each with its own winners.
    found = own.select("query_id", "vec_id", "score").unionByName(solved(routed)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    if looked_at is not None:
        looked_at["all"] = asked.count() * rows.count()
    return ranked(found).select("query_id", "rank", "vec_id", "score")
