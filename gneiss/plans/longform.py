"""Long tables that the operators share: melted values, frequencies, order statistics.

One column per feature becomes one row per cell, so thousands of features are one aggregate with a partial step before the
shuffle, not thousands of expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.values import is_numeric


def melt(df: DataFrame, features: list[str], keys: dict[str, Column] | None = None, numeric: bool = True) -> DataFrame:
    """Keys, ``feature`` and ``value``: double for numeric features, else string."""
    kind = "double" if numeric else "string"
    keys = keys or {}
    parts = [c.alias(f"key_{k}") for k, c in keys.items()]
    wide = df.select(*parts, *[F.col(f"`{f}`").cast(kind).alias(f) for f in features])
    long = wide.unpivot([f"key_{k}" for k in keys], [f"`{f}`" for f in features], "feature", "value")
    return long.withColumnsRenamed({f"key_{k}": k for k in keys})


def split_kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    numbers = [f for f in features if is_numeric(df.schema[f].dataType)]
    return numbers, [f for f in features if f not in numbers]


def frequencies(long: DataFrame, by: list[str]) -> DataFrame:
    """``n`` rows for each value."""
    return long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def nearest(q: float) -> Column:
    """The rank ``round((n - 1) q)`` of n values."""
    return F.round((F.col("total") - 1) * F.lit(float(q)))


def middle(upper: bool) -> Column:
    """The ranks between which the median lies."""
    half = (F.col("total") - 1) / 2
    return F.ceil(half) if upper else F.floor(half)


def order_statistics(freq: DataFrame, by: list[str], probabilities: list[float], spread: int = 32) -> DataFrame:
    """Values of nearest rank: for each key and q the value of rank ``round((n - 1) q)``, in the long columns ``q`` and ``value``."""
    found = ranked(freq, by, {str(i): nearest(q) for i, q in enumerate(probabilities)}, spread)
    of = F.element_at(F.array(*[F.lit(float(q)) for q in probabilities]), F.col("name").cast("int") + 1)
    return found.select(*by, of.alias("q"), "value")


def ranked(freq: DataFrame, by: list[str], ranks: dict[str, Column], spread: int = 32) -> DataFrame:
    """Values of the given ranks (expressions of ``total``, the number of values) of each key, in the long columns ``name`` and ``value``.

    ``freq`` is read several times, so it had better be a stored table.  Running counts are not taken over a whole feature in one task:
    approximate quantiles, gathered on the driver with ``spread`` numbers for each feature, cut the values into ranges; the ranges' sums
    give each range its offset.
    """
    freq = freq.where(F.col("value").isNotNull() & ~F.isnan("value"))
    cuts = freq.groupBy("feature").agg(F.percentile_approx("value", [i / spread for i in range(1, spread)], F.lit(1000)).alias("cuts")).collect() if spread > 1 else []
    if cuts:
        ends = F.broadcast(freq.sparkSession.createDataFrame([(r["feature"], sorted(set(r["cuts"]))) for r in cuts], "feature string, cuts array<double>"))
        freq = freq.join(ends, "feature").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    else:
        freq = freq.withColumn("range", F.lit(0))
    sums = freq.groupBy(*by, "range").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*by)
    sums = sums.select(*by, "range", "m", (F.sum("m").over(w.orderBy("range")) - F.col("m")).alias("before"), F.sum("m").over(w).alias("total"))
    # Only ranges in which a rank lies are sorted.
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("w")
    asked = sums.select("*", wanted).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("m")))
    asked = asked.groupBy(*by, "range", "before").agg(F.collect_list("w").alias("asked"))
    same = None
    for k in [*by, "range"]:
        one = F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
        same = one if same is None else same & one
    run = freq.alias("f").join(asked.alias("s"), same).select(*[F.col(f"f.{k}").alias(k) for k in by], "f.value", "f.n", "f.range", "s.before", "s.asked")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    # Sums first: a generator in the same projection would multiply the rows that they run over.
    run = run.select(*by, "value", "n", upto.alias("upto"), "asked").select(*by, "value", "n", "upto", F.explode("asked").alias("w"))
    return run.where((F.col("upto") > F.col("w.rank")) & (F.col("upto") - F.col("n") <= F.col("w.rank"))).select(*by, F.col("w.name").alias("name"), "value")
