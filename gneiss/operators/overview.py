"""Data quality and descriptive statistics by feature, in total and by group."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.values import Sentinels, among, cleaned
from gneiss.plans.longform import frequencies, melt, middle, nearest, ranked, split_kinds
from gneiss.plans.store import stored

DQ = ("missing", "zeros", "unique", "top1")
MOMENTS = ("mean", "std", "min", "max", "sum", "skew", "kurtosis")
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
TOTAL = "total"


@dataclass(frozen=True)
class ProfileConfig:
    """What a profile holds."""

    stat_metrics: tuple[str, ...] = ("mean", "std", "min", "p25", "median", "p75", "max", "skew", "kurtosis")
    dq_metrics: tuple[str, ...] = DQ
    sparkline: bool = True
    sparkline_bins: int = 8
    sparkline_rows: int | None = None
    missing: tuple = ()
    special: tuple = ()
    psi_bins: int = 10
    psi_method: str = "quantile"
    psi_ignore: float = 0.05

    def but(self, **changes) -> ProfileConfig:
        return replace(self, **changes)

    @property
    def sentinels(self) -> Sentinels:
        return Sentinels.of(self.missing, self.special)


def _moment(name: str, clean: Column) -> Column:
    number = F.when(~F.isnan(clean), clean)
    made = {"mean": F.avg(clean), "std": F.stddev_samp(clean), "min": F.min(number), "max": F.max(number), "sum": F.sum(clean), "skew": F.skewness(clean), "kurtosis": F.kurtosis(clean)}
    return made[name].alias(name) if name in made else F.lit(None).cast("double").alias(name)


def _levels(group: Column | None) -> dict[str, Column]:
    return {} if group is None else {"grp": group}


def _by_level(df: DataFrame, grouped: bool, *aggregates: Column) -> DataFrame:
    """Aggregates by feature and, with groups, by feature and group; ``is_total`` tells the two apart."""
    if not grouped:
        return df.groupBy("feature").agg(*aggregates).withColumn("grp", F.lit(None).cast("string")).withColumn("is_total", F.lit(True))
    out = df.groupingSets([["feature", "grp"], ["feature"]], "feature", "grp").agg(*aggregates, (F.grouping("grp") == 1).alias("is_total"))
    return out.withColumn("grp", F.col("grp").cast("string"))


def moments(df: DataFrame, features: list[str], sentinels: Sentinels, names: tuple[str, ...] = MOMENTS, group: Column | None = None) -> DataFrame:
    """Rates and moments of numeric features from one pass over the melted values."""
    long = melt(df, features, _levels(group))
    v = F.col("value")
    clean = cleaned(v, sentinels.numbers("missing") + sentinels.numbers("special"))
    n = F.count(F.lit(1))
    gone = F.sum((v.isNull() | among(v, sentinels.numbers("missing"))).cast("long"))
    zero = F.sum(F.coalesce((v == 0).cast("long"), F.lit(0)))
    return _by_level(long, group is not None, n.alias("rows"), (gone / n).alias("missing"), (zero / n).alias("zeros"), *[_moment(m, clean) for m in names])


def counts(df: DataFrame, features: list[str], sentinels: Sentinels, numeric: bool, group: Column | None = None) -> DataFrame:
    """Rates, distinct values and the commonest value from the frequency table; null is a value.

    Ties go to the smallest value, nulls last.
    """
    grouped = group is not None
    freq = frequencies(melt(df, features, _levels(group), numeric), ["feature", *_levels(group)])
    if grouped:
        total = freq.groupBy("feature", "value").agg(F.sum("n").alias("n")).select("feature", F.lit(None).cast("string").alias("grp"), F.lit(True).alias("is_total"), "value", "n")
        freq = freq.select("feature", F.col("grp").cast("string").alias("grp"), F.lit(False).alias("is_total"), "value", "n").unionByName(total)
    else:
        freq = freq.select("feature", F.lit(None).cast("string").alias("grp"), F.lit(True).alias("is_total"), "value", "n")
    v = F.col("value")
    missing = F.sum(F.when(v.isNull() | among(v, sentinels.typed("missing", numeric)), F.col("n")).otherwise(0))
    zeros = F.sum(F.when(v == 0, F.col("n")).otherwise(0)) if numeric else F.lit(0).cast("long")
    best = F.min(F.struct((-F.col("n")).alias("n"), v.isNull().alias("no"), v.alias("value")))
    rows = F.sum("n")
    out = freq.groupBy("feature", "grp", "is_total").agg(rows.alias("rows"), (missing / rows).alias("missing"), (zeros / rows).alias("zeros"), (F.count(F.lit(1)) / rows).alias("unique"), (-best["n"] / rows).alias("top1"), best["value"].cast("string").alias("top1_value"))
    return out


def approximate_unique(df: DataFrame, features: list[str], numeric: bool = True, error: float = 0.02) -> DataFrame:
    """Distinct values by a sketch, null included: bounded memory for features with very many values."""
    long = melt(df, features, numeric=numeric)
    made = F.approx_count_distinct("value", error) + F.max(F.col("value").isNull().cast("int"))
    return long.groupBy("feature").agg((made / F.count(F.lit(1))).alias("unique"))


def quantiles(df: DataFrame, features: list[str], sentinels: Sentinels, names: dict[str, float], group: Column | None = None) -> DataFrame:
    """Nearest-rank quantiles, and the median, which lies midway between the two middle values."""
    by = ["feature", *_levels(group)]
    clean = cleaned(F.col("value"), sentinels.numbers("missing") + sentinels.numbers("special"))
    freq = stored(frequencies(melt(df, features, _levels(group)).withColumn("value", clean).where("value is not null"), by))
    if group is not None:
        total = freq.groupBy("feature", "value").agg(F.sum("n").alias("n")).select("feature", F.lit(None).cast("string").alias("grp"), F.lit(True).alias("is_total"), "value", "n")
        freq = freq.select("feature", F.col("grp").cast("string").alias("grp"), F.lit(False).alias("is_total"), "value", "n").unionByName(total)
        by = ["feature", "grp", "is_total"]
    ranks = {m: nearest(q) for m, q in names.items() if m != "median"}
    if "median" in names:
        ranks |= {"lower": middle(False), "upper": middle(True)}
    at = lambda m: F.max(F.when(F.col("name") == m, F.col("value")))
    out = ranked(freq, by, ranks).groupBy(*by).agg(*[((at("lower") + at("upper")) / 2 if m == "median" else at(m)).alias(m) for m in names])
    if group is None:
        out = out.withColumn("grp", F.lit(None).cast("string")).withColumn("is_total", F.lit(True))
    return out


def overview(df: DataFrame, features: list[str], config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """One row for each feature: type, rates, commonest value and statistics, sorted by type and name."""
    numbers, others = split_kinds(df, features)
    kinds = df.sparkSession.createDataFrame([(f, df.schema[f].dataType.simpleString()) for f in features], "feature string, dtype string")
    s = config.sentinels
    rates = ["missing", "zeros", "unique", "top1", "top1_value"]
    parts = []
    if numbers:
        parts.append(counts(df, numbers, s, True).select("feature", *rates))
    if others:
        parts.append(counts(df, others, s, False).select("feature", *rates))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    near = {m: QUANTILES[m] for m in config.stat_metrics if m in QUANTILES}
    rest = tuple(m for m in config.stat_metrics if m not in QUANTILES)
    if numbers and rest:
        out = out.join(moments(df, numbers, s, rest).select("feature", *rest), "feature", "left")
    if numbers and near:
        out = out.join(quantiles(df, numbers, s, near).select("feature", *near), "feature", "left")
    out = F.broadcast(kinds).join(out, "feature", "left")
    out = out.withColumnsRenamed({"missing": "missing_rate", "zeros": "zeros_rate", "unique": "unique_rate", "top1": "top1_ratio"})
    stats = [F.col(m) if m in out.columns else F.lit(None).cast("double").alias(m) for m in config.stat_metrics]
    return out.select("feature", "dtype", "missing_rate", "zeros_rate", "unique_rate", "top1_ratio", "top1_value", *stats).orderBy("dtype", "feature")


def trend(df: DataFrame, features: list[str], metric: str, group: Column, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """``feature``, ``grp``, ``is_total`` and ``value`` of one metric, by group and in total."""
    return trends(df, features, (metric,), group, config)[metric]


def trends(df: DataFrame, features: list[str], metrics: tuple[str, ...], group: Column, config: ProfileConfig = ProfileConfig()) -> dict[str, DataFrame]:
    """The trend of each metric.

    Metrics of one kind come from one aggregate: one pass for all rates and moments, one for distinct values, one for quantiles.  With several
    metrics each such table, of a row for each feature and group, is stored, so that no trend computes it again.  Statistics need numeric
    features; an unknown metric is refused.
    """
    numbers, others = split_kinds(df, features)
    s = config.sentinels
    for m in metrics:
        if m not in (*DQ, *MOMENTS, *QUANTILES):
            raise ValueError(f"unknown metric {m!r}")
        if m not in DQ and not numbers:
            raise ValueError(f"{m} needs numeric features")
    of = lambda names: tuple(m for m in metrics if m in names)
    made: dict[str, list[DataFrame]] = {m: [] for m in metrics}

    def keep(table: DataFrame, names: tuple[str, ...]) -> None:
        table = stored(table) if len(metrics) > 1 else table
        for m in names:
            made[m].append(table.select("feature", "grp", "is_total", F.col(m).cast("double").alias("value")))

    if numbers and of(("missing", "zeros", *MOMENTS)):
        keep(moments(df, numbers, s, of(MOMENTS), group), of(("missing", "zeros", *MOMENTS)))
    if numbers and of(("unique", "top1")):
        keep(counts(df, numbers, s, True, group), of(("unique", "top1")))
    if others and of(DQ):
        keep(counts(df, others, s, False, group), of(DQ))
    if numbers and of(tuple(QUANTILES)):
        keep(quantiles(df, numbers, s, {m: QUANTILES[m] for m in of(tuple(QUANTILES))}, group), of(tuple(QUANTILES)))
    return {m: p[0] if len(p) == 1 else p[0].unionByName(p[1]) for m, p in made.items()}


def stability(long: DataFrame) -> DataFrame:
    """Mean, variance and coefficient of variation over groups of a trend; null becomes 0."""
    own = long.where(~F.col("is_total"))
    mean, var, sd = F.coalesce(F.avg("value"), F.lit(0.0)), F.coalesce(F.var_samp("value"), F.lit(0.0)), F.stddev_samp("value")
    return own.groupBy("feature").agg(mean.alias("group_mean"), var.alias("group_var"), F.coalesce(sd / (F.abs(mean) + 1e-9), F.lit(0.0)).alias("group_cv"))


def pivoted(long: DataFrame, groups: list[str] | None = None, with_stability: bool = False) -> DataFrame:
    """One column for each group, then the total, then the stability columns."""
    if groups is None:
        groups = [r[0] for r in long.where("not is_total and grp is not null").select("grp").distinct().orderBy("grp").collect()]
    # A group that is itself named so does not fall together with the total.
    named = {g: f"{g} (group)" if g == TOTAL else g for g in groups}
    name = F.when(F.col("is_total"), TOTAL).when(F.col("grp") == TOTAL, named.get(TOTAL, TOTAL)).otherwise(F.col("grp"))
    wide = long.withColumn("name", name).groupBy("feature").pivot("name", [*named.values(), TOTAL]).agg(F.first("value"))
    return wide.join(stability(long), "feature", "left").orderBy("feature") if with_stability else wide.orderBy("feature")


def sparklines(df: DataFrame, features: list[str], config: ProfileConfig = ProfileConfig(), seed: int = 7) -> DataFrame:
    """``feature`` and ``distribution``: a glyph for each bin of an equal-width histogram.

    Constants have a lone bar, features without values a flat line.  All rows are counted; only where ``sparkline_rows`` is set are
    tables of more rows sampled.
    """
    glyphs, bins = "▂▃▄▅▆▇█", config.sparkline_bins
    some = df
    if config.sparkline_rows is not None and (total := df.count()) > config.sparkline_rows:
        some = df.sample(fraction=config.sparkline_rows / total, seed=seed)
    s = config.sentinels
    clean = cleaned(F.col("value"), s.numbers("missing") + s.numbers("special"))
    long = melt(some, features).withColumn("value", clean).where("value is not null and not isnan(value)")
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spot = F.greatest(F.lit(0), F.ceil((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int") - 1)
    rows = long.join(F.broadcast(ends), "feature").withColumn("bin", F.when(F.col("lo") == F.col("hi"), F.lit(-1)).otherwise(F.least(F.lit(bins - 1), spot)))
    sums = rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("most", F.max("n").over(Window.partitionBy("feature")))
    level = F.floor(F.col("n") / F.col("most") * 6).cast("int")
    sums = sums.withColumn("glyph", F.substring(F.lit(glyphs), level + 1, F.lit(1)))
    held = sums.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "glyph"))).alias("bars"))
    drawn = F.when(F.map_contains_key("bars", F.lit(-1)), F.lit("____█____")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("bars", i), F.lit("_"))), ""))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(held, "feature", "left").select("feature", F.when(F.col("bars").isNull(), F.lit("_" * bins)).otherwise(drawn).alias("distribution"))
