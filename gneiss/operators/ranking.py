"""Ranking metrics of a score against a binary target, and tables of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-10


def score_table(df: DataFrame, score: Column, target: Column) -> DataFrame:
    """Goods and bads of each distinct score; rows with a null or NaN in either column are left out."""
    rows = df.select(score.cast("double").alias("score"), target.cast("double").alias("y")).where("score is not null and y is not null and not isnan(score) and not isnan(y)")
    return rows.groupBy("score").agg(F.sum((F.col("y") == 1).cast("long")).alias("bad"), F.sum((F.col("y") == 0).cast("long")).alias("good"))


def _running(table: DataFrame, spread: int = 64) -> DataFrame:
    """Counts below each score, in ranges of scores so that no task holds all distinct scores."""
    cuts = table.agg(F.percentile_approx("score", [i / spread for i in range(1, spread)], F.lit(1000))).first()[0] or []
    ends = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in ends]), lambda c: c < F.col("score"))) if ends else F.lit(0)
    table = table.withColumn("part", part)
    sums = table.groupBy("part").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    w = Window.orderBy("part")
    sums = sums.select("part", (F.sum("b").over(w) - F.col("b")).alias("b0"), (F.sum("g").over(w) - F.col("g")).alias("g0"))
    own = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    return table.join(F.broadcast(sums), "part").select("score", "bad", "good", (F.col("b0") + F.sum("bad").over(own)).alias("cum_bad"), (F.col("g0") + F.sum("good").over(own)).alias("cum_good"))


def auc(df: DataFrame, score: Column, target: Column) -> DataFrame:
    """One row ``auc``: ties count half, a single class gives 0.5."""
    run = _running(score_table(df, score, target))
    pairs = F.sum(F.col("bad").cast("double") * (F.col("cum_good") - F.col("good") + F.col("good") / 2))
    return run.agg(F.coalesce(F.try_divide(pairs, F.sum("bad").cast("double") * F.sum("good")), F.lit(0.5)).alias("auc"))


def ks(df: DataFrame, score: Column, target: Column) -> DataFrame:
    """One row ``ks``: the largest distance between the two classes' distributions."""
    run = _running(score_table(df, score, target))
    ends = run.agg(F.sum("bad").alias("B"), F.sum("good").alias("G"))
    gap = F.abs(F.try_divide("cum_bad", "B") - F.try_divide("cum_good", "G"))
    return run.crossJoin(F.broadcast(ends)).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def bin_table(df: DataFrame, bin_col: str, target_col: str, ascending: bool = True) -> DataFrame:
    """Counts, shares, WOE, lift, IV and KS of each bin, with running shares in the order asked for.

    WOE here is ln(share of goods / (share of bads + 1e-10)): minus infinity where a bin has no goods.
    """
    y = F.col(target_col)
    rows = df.groupBy(F.col(bin_col).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.sum((y == 1).cast("long")).alias("bad"), F.sum((y == 0).cast("long")).alias("good"), F.avg(y.cast("double")).alias("bad_rate"))
    rows = rows.withColumns({"bad": F.coalesce("bad", F.lit(0)), "good": F.coalesce("good", F.lit(0))})
    every = Window.partitionBy(F.lit(1))
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(every))
    out = rows.withColumns({"pct_bad": share("bad"), "pct_good": share("good"), "pct_total": share("count"), "overall": F.sum("bad").over(every) / F.sum("count").over(every)})
    log = lambda x: F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))
    out = out.withColumn("woe", log(F.col("pct_good") / (F.col("pct_bad") + EPSILON))).withColumn("lift", F.col("bad_rate") / (F.col("overall") + EPSILON))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("bin").asc() if ascending else F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"iv_contribution": (F.col("pct_good") - F.col("pct_bad")) * F.col("woe"), "cum_pct_bad": F.sum("pct_bad").over(w), "cum_pct_good": F.sum("pct_good").over(w)})
    out = out.withColumn("ks_spread", F.abs(F.col("cum_pct_bad") - F.col("cum_pct_good"))).drop("overall")
    return out.orderBy(F.col("bin").asc() if ascending else F.col("bin").desc())


def ks_binned(df: DataFrame, bin_col: str, target_col: str) -> DataFrame:
    return bin_table(df, bin_col, target_col).agg(F.max("ks_spread").alias("ks"))
