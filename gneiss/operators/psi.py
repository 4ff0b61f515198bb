"""Population stability: how far each group's distribution over bins lies from the first group's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.values import Sentinels
from gneiss.operators.binning import MISSING, SPECIAL, Binning, fit
from gneiss.plans.longform import frequencies, melt, split_kinds
from gneiss.plans.store import stored

#: Share of a bin that a group does not have.
ABSENT = 1e-6


def _from_counts(counts: DataFrame, skeleton: DataFrame) -> DataFrame:
    """PSI from ``grp``, ``feature``, ``bin``, ``n`` over all bins of ``skeleton`` (``feature``, ``bin``).

    Rows of a null group are left out of the groups and of the total.  ``is_total`` rows compare all rows with the baseline.
    Groups and bins are few, so their cross product is small whatever the table's size.
    """
    # Few rows, read by several branches.
    counts = stored(counts.where("grp is not null"))
    base = counts.agg(F.min("grp").alias("base"))
    whole = counts.groupBy("feature", "bin").agg(F.sum("n").alias("n")).withColumn("grp", F.lit(None).cast(counts.schema["grp"].dataType))
    shares = counts.withColumn("is_total", F.lit(False)).unionByName(whole.withColumn("is_total", F.lit(True)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("is_total", "grp", "feature"))
    shares = shares.withColumn("share", share)
    expected = shares.where("not is_total").join(F.broadcast(base), F.col("grp") == F.col("base")).select("feature", "bin", F.col("share").alias("e"))
    groups = shares.select("grp", "is_total").distinct()
    cells = skeleton.crossJoin(F.broadcast(groups)).alias("c")
    found = cells.join(shares.alias("s"), (F.col("c.feature") == F.col("s.feature")) & (F.col("c.bin") == F.col("s.bin")) & (F.col("c.is_total") == F.col("s.is_total")) & F.col("c.grp").eqNullSafe(F.col("s.grp")), "left")
    found = found.select("c.feature", "c.bin", "c.grp", "c.is_total", F.coalesce("s.share", F.lit(ABSENT)).alias("a")).join(expected, ["feature", "bin"], "left")
    e = F.coalesce("e", F.lit(ABSENT))
    return found.groupBy("feature", "grp", "is_total").agg(F.sum((F.col("a") - e) * F.log(F.col("a") / e)).alias("psi"))


def numeric_psi(df: DataFrame, features: list[str], group: Column, n_bins: int = 10, method: str = "quantile", sentinels: Sentinels = Sentinels(), binning: Binning | None = None) -> DataFrame:
    """``feature``, ``grp``, ``is_total``, ``psi`` over bins fitted on all rows, missing and special values included."""
    own = binning or fit(df, features, method, n_bins, sentinels=sentinels)
    counts = own.long_counts(df, keys={"grp": group})
    bins = [*range(n_bins), MISSING, *[SPECIAL - i for i in range(len(sentinels.numbers("special")))]]
    skeleton = df.sparkSession.createDataFrame([(f, b) for f in features for b in bins], "feature string, bin short")
    return _from_counts(counts, skeleton)


def categorical_psi(df: DataFrame, features: list[str], group: Column) -> DataFrame:
    """The same over categories; null is the category "Missing"."""
    long = melt(df, features, {"grp": group}, numeric=False).withColumn("value", F.coalesce("value", F.lit("Missing")))
    counts = frequencies(long, ["grp", "feature"]).withColumnRenamed("value", "bin")
    counts = stored(counts)
    return _from_counts(counts, counts.where("grp is not null").select("feature", "bin").distinct())


def psi(df: DataFrame, features: list[str], group: Column, n_bins: int = 10, method: str = "quantile", sentinels: Sentinels = Sentinels()) -> DataFrame:
    numbers, others = split_kinds(df, features)
    parts = [numeric_psi(df, numbers, group, n_bins, method, sentinels)] if numbers else []
    parts += [categorical_psi(df, others, group)] if others else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def psi_stability(long: DataFrame, ignore: float = 0.05) -> DataFrame:
    """Mean, variance and coefficient of variation over groups; the last is 0 where no group reaches ``ignore``."""
    own = long.where(~F.col("is_total"))
    mean = F.avg("psi")
    cv = F.when(F.max("psi") < ignore, 0.0).otherwise(F.coalesce(F.stddev_samp("psi") / (mean + 1e-9), F.lit(0.0)))
    return own.groupBy("feature").agg(mean.alias("group_mean"), F.coalesce(F.var_samp("psi"), F.lit(0.0)).alias("group_var"), cv.alias("group_cv"))
