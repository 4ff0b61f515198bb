"""Cut search over small count tables: a decision tree's splits, and the best merge of ordered bins."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.store import stored

#: Distinct values of a feature above which its tree is grown by rounds over the cluster instead of in one task; the cuts are the same.
FINE = 8192
#: Most value ranges of such a feature.
_RANGES = 1024


def tree_cuts(value: np.ndarray, n: np.ndarray, bad: np.ndarray, leaves: int, min_share: float) -> list[float]:
    """Thresholds of the tree that is grown best split first by Gini impurity, up to ``leaves`` leaves.

    Values are distinct and sorted; every leaf holds ``min_share`` of the rows at least; of equal splits the lowest is taken.
    """
    total = int(n.sum())
    least = max(1, math.ceil(min_share * total))
    if total < 10 * leaves or len(value) < 2:
        return []
    cn, cb = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(bad)))

    def impurity(k, b):
        return np.where(k > 0, 2 * b * (k - b) / np.maximum(k, 1), 0.0)

    def best(i: int, j: int):
        at = np.arange(i + 1, j)
        if not len(at):
            return None
        left, right = cn[at] - cn[i], cn[j] - cn[at]
        gain = impurity(cn[j] - cn[i], cb[j] - cb[i]) - impurity(left, cb[at] - cb[i]) - impurity(right, cb[j] - cb[at])
        gain = np.where((left >= least) & (right >= least), gain, -1.0)
        k = int(gain.argmax())
        return (-float(gain[k]), i, j, int(at[k])) if gain[k] > 1e-12 else None

    heap, out = [], []
    if (first := best(0, len(value))) is not None:
        heap.append(first)
    while heap and len(out) + 1 < leaves:
        _, i, j, k = heapq.heappop(heap)
        out.append((float(value[k - 1]) + float(value[k])) / 2)
        for part in (best(i, k), best(k, j)):
            if part is not None:
                heapq.heappush(heap, part)
    return sorted(out)


def cart_cuts(long: DataFrame, leaves: int, min_share: float) -> dict[str, list[float]]:
    """Tree cuts of each feature from ``feature``, ``value``, ``y``."""
    rows = long.where("value is not null and not isnan(value) and y is not null")
    return cuts_of_counts(rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")), leaves, min_share)


def cuts_of_counts(freq: DataFrame, leaves: int, min_share: float) -> dict[str, list[float]]:
    """Tree cuts of each feature from ``feature``, ``value``, its rows ``n`` and bads ``bad``, between any two distinct values.

    Values are compared in single precision.  A feature of up to ``FINE`` distinct values has its tree grown in one task, others by rounds
    over running counts that are spread by value ranges.
    """
    rows = freq.withColumn("value", F.col("value").cast("float").cast("double"))
    freq = stored(rows.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("bad").cast("double").alias("bad")))
    sizes = {r["feature"]: r["d"] for r in freq.groupBy("feature").agg(F.count(F.lit(1)).alias("d")).collect()}
    many = [f for f, d in sizes.items() if d > FINE]
    wide = {}
    if many:
        spread = min(_RANGES, -(-max(sizes.values()) // FINE))
        wide = _grown(_running(freq.where(F.col("feature").isin(many)), spread), leaves, min_share)
        freq = freq.where(~F.col("feature").isin(many))

    def grow(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        found = tree_cuts(pdf["value"].to_numpy(), pdf["n"].to_numpy(), pdf["bad"].to_numpy(), leaves, min_share)
        return pd.DataFrame({"feature": [key[0]], "cuts": [found]})

    return wide | {r["feature"]: list(r["cuts"]) for r in freq.groupBy("feature").applyInPandas(grow, "feature string, cuts array<double>").collect()}


def _with_range(frames: Iterable[pd.DataFrame], ends: dict[str, np.ndarray]) -> Iterable[pd.DataFrame]:
    for pdf in frames:
        for feature, part in pdf.groupby("feature"):
            yield part.assign(range=np.searchsorted(ends[feature], part["value"].to_numpy()).astype(np.int32))


def _running(freq: DataFrame, spread: int) -> DataFrame:
    """``feature``, ``value``, the ``next`` value, and rows ``cn`` and bads ``cb`` up to the value.

    Each range is summed for itself and the ranges' sums give the offsets, so no task holds a whole feature.
    """
    ends = freq.groupBy("feature").agg(F.percentile_approx("value", [i / spread for i in range(1, spread)] or [0.5], F.lit(10 * spread)).alias("ends")).collect()
    shared = freq.sparkSession.sparkContext.broadcast({r["feature"]: np.unique(r["ends"]) for r in ends})
    freq = freq.mapInPandas(lambda x: _with_range(x, shared.value), "feature string, value double, n long, bad double, range int")
    whole = Window.partitionBy("feature").orderBy("range")
    sums = freq.groupBy("feature", "range").agg(F.sum("n").alias("rn"), F.sum("bad").alias("rb"), F.min("value").alias("least"))
    sums = sums.select("feature", "range", (F.sum("rn").over(whole) - F.col("rn")).alias("n0"), (F.sum("rb").over(whole) - F.col("rb")).alias("b0"), F.lead("least").over(whole).alias("after"))
    own = Window.partitionBy("feature", "range").orderBy("value")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = freq.select("*", F.sum("n").over(upto).alias("un"), F.sum("bad").over(upto).alias("ub"), F.lead("value").over(own).alias("follows")).join(F.broadcast(sums), ["feature", "range"])
    return stored(out.select("feature", "value", F.coalesce("follows", "after").alias("next"), (F.col("n0") + F.col("un")).alias("cn"), (F.col("b0") + F.col("ub")).alias("cb")))


def _grown(running: DataFrame, leaves: int, min_share: float) -> dict[str, list[float]]:
    """The cuts of :func:`tree_cuts`; a round finds the best split of the newest two leaves of every feature."""
    spark = running.sparkSession
    total = {r["feature"]: (r["n"], r["b"]) for r in running.groupBy("feature").agg(F.max("cn").alias("n"), F.max_by("cb", "cn").alias("b")).collect()}
    heaps: dict[str, list] = {f: [] for f in total}
    out: dict[str, list[float]] = {f: [] for f in total}
    # A leaf is the rows and bads before it and up to its end.
    leaf = [(f, 0, 0.0, n, float(b), max(1, math.ceil(min_share * n))) for f, (n, b) in total.items() if n >= 10 * leaves]

    def impurity(k, b):
        return 2 * b * (k - b) / k

    left, right = F.col("cn") - F.col("n0"), F.col("n1") - F.col("cn")
    gain = impurity(F.col("n1") - F.col("n0"), F.col("b1") - F.col("b0")) - impurity(left, F.col("cb") - F.col("b0")) - impurity(right, F.col("b1") - F.col("cb"))
    while leaf and leaves > 1:
        own = F.broadcast(spark.createDataFrame(leaf, "feature string, n0 long, b0 double, n1 long, b1 double, least long"))
        able = running.join(own, "feature").where((F.col("cn") > F.col("n0")) & (F.col("cn") < F.col("n1"))).where((left >= F.col("least")) & (right >= F.col("least")))
        best = able.groupBy("feature", "n0", "b0", "n1", "b1", "least").agg(F.min(F.struct((-gain).alias("gain"), "value", "next", "cn", "cb")).alias("x")).where("x.gain < -1e-12")
        for r in best.collect():
            heapq.heappush(heaps[r["feature"]], (r["x"]["gain"], r["n0"], tuple(r)))
        seen, leaf = {x[0] for x in leaf}, []
        for f in seen:
            if not heaps[f]:
                continue
            _, n0, b0, n1, b1, least, x = heapq.heappop(heaps[f])[2]
            out[f].append((x["value"] + x["next"]) / 2)
            if len(out[f]) + 1 < leaves:
                leaf += [(f, n0, b0, x["cn"], x["cb"], least), (f, x["cn"], x["cb"], n1, b1, least)]
    return {f: sorted(cuts) for f, cuts in out.items()}


def _iv(n: float, bad: float, total: float, bads: float) -> float:
    good = n - bad
    p, q = (bad + 0.5) / (bads + 0.5), (good + 0.5) / (total - bads + 0.5)
    return (p - q) * math.log(p / q)


def best_merge(counts: list[tuple[float, float]], most: int, least: float, directions: tuple[int, ...]) -> list[int]:
    """Inner borders of the merge of consecutive (rows, bads) with the largest information value.

    At most ``most`` bins of ``least`` rows each; the bad rate rises (1), falls (-1) or is free (0).  Exact dynamic programming
    over the last bin's ends and the number of bins.
    """
    b = len(counts)
    cn, cb = [0.0], [0.0]
    for n, bad in counts:
        cn.append(cn[-1] + n)
        cb.append(cb[-1] + bad)
    total, bads = cn[-1], cb[-1]
    value = {(i, j): _iv(cn[j] - cn[i], cb[j] - cb[i], total, bads) for i in range(b) for j in range(i + 1, b + 1) if cn[j] - cn[i] >= least and cn[j] > cn[i]}
    rate = {k: (cb[k[1]] - cb[k[0]]) / (cn[k[1]] - cn[k[0]]) for k in value}
    best: tuple[float, list[int]] = (-1.0, [])
    for d in directions:
        state = {k: (v, None) for k, v in value.items() if k[0] == 0}
        levels = [state]
        for _ in range(most - 1):
            now: dict = {}
            for (i, j), (v, _) in levels[-1].items():
                for k in range(j + 1, b + 1):
                    if (j, k) in value and (d == 0 or d * (rate[j, k] - rate[i, j]) > 0):
                        new = v + value[j, k]
                        if (j, k) not in now or new > now[j, k][0] + 1e-15:
                            now[j, k] = (new, (i, j))
            levels.append(now)
        for depth, level in enumerate(levels):
            for (i, j), (v, _) in level.items():
                if j == b and v > best[0] + 1e-12:
                    borders, at = [], (i, j)
                    for x in range(depth, 0, -1):
                        borders.append(at[0])
                        at = levels[x][at][1]
                    best = (v, sorted(borders))
    return best[1]


DIRECTIONS = {"auto_asc_desc": (1, -1), "auto": (1, -1), "ascending": (1,), "descending": (-1,), "none": (0,), None: (0,)}


def merge_cuts(edges: list[float], counts: dict[int, tuple], n_bins: int, min_share: float, trend: str | None) -> list[float]:
    """Edges after the best merge; the edges as they are where there is too little to merge or the merge leaves one bin."""
    if len(edges) <= 3:
        return edges
    rows = [counts.get(i, (0, 0.0)) for i in range(len(edges) - 1)]
    total = sum(r[0] for r in rows)
    if total < 10:
        return edges
    if trend not in DIRECTIONS:
        raise ValueError(f"trend must be one of {[k for k in DIRECTIONS if k]}")
    borders = best_merge([(float(n), float(b)) for n, b in rows], n_bins, min_share * total, DIRECTIONS[trend])
    return [edges[0], *[edges[i] for i in borders], edges[-1]] if borders else edges


def category_groups(rows: list[tuple], n_bins: int, rare_share: float, min_share: float) -> list[list[str]]:
    """Groups of categories: rare ones together, then all ordered by bad rate and merged as numeric bins are."""
    total = sum(r[1] for r in rows)
    if not total:
        return []
    units = [([v], n, b) for v, n, b in rows if n >= rare_share * total]
    rare = [r for r in rows if r[1] < rare_share * total]
    if rare:
        units.append(([r[0] for r in rare], sum(r[1] for r in rare), sum(r[2] for r in rare)))
    units.sort(key=lambda u: (u[2] / u[1], u[0]))
    borders = best_merge([(float(n), float(b)) for _, n, b in units], n_bins, min_share * total, (0,))
    ends = [0, *borders, len(units)]
    return [[v for u in units[a:b] for v in u[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
