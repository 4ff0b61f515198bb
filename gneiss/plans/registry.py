"""The registered queries of the engine's operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import dates
from gneiss.functions.values import Sentinels
from gneiss.operators import binning, overview, psi, ranking
from gneiss.plans.longform import frequencies, melt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Sentinel values, a binary target and calendar groups for lineitem; the same text runs on both engines.
DIRTY = {
    "price_dirty": "CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 = 1 THEN -999.0 WHEN l_orderkey % 10 = 2 THEN -1.0 ELSE l_extendedprice END",
    "qty_dirty": "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN -998 ELSE CAST(l_quantity AS BIGINT) END",
    "flag_dirty": "CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN 'unknown' ELSE l_returnflag END",
    "bad": "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT)",
    "ship_month": "CAST(date_trunc('month', l_shipdate) AS DATE)",
}
ROLES = Sentinels.of((-999, "unknown"), (-1, -998))
DIRTY_SQL = "d AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in DIRTY.items()) + " FROM lineitem)"


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem")
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in DIRTY.items()])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _melted(features: list[str], table: str, keys: str = "", kind: str = "DOUBLE", name: str = "m") -> str:
    keys = f"{keys}, " if keys else ""
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT {keys}'{f}' AS feature, CAST({f} AS {kind}) AS v FROM {table}" for f in features) + ")"


# ---- overview

_QUANTILE = "max(CASE WHEN r = CAST(round((k - 1) * {q}) AS BIGINT) THEN v END)"
_CLEAN = "v IS NOT NULL AND v NOT IN (-999, -1, -998)"


@_query(
    "overview_basic",
    f"WITH {_melted(MEASURES, 'lineitem')} SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_rate, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END), 6) AS zeros_rate,"
    " round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max FROM m GROUP BY feature",
)
def overview_basic(spark, sf):
    out = overview.moments(_table(spark, sf, "lineitem"), MEASURES, Sentinels(), ("mean", "std", "min", "max"))
    return _rounded(out.select("feature", F.col("missing").alias("missing_rate"), F.col("zeros").alias("zeros_rate"), "mean", "std", "min", "max"), "missing_rate", "zeros_rate", "mean", "std")


_DQ_COLUMNS = "SELECT feature, round(sum(gone) / sum(n), 6) AS missing_rate, round(sum(CASE WHEN zero THEN n ELSE 0 END) / sum(n), 6) AS zeros_rate, round(count(*) / sum(n), 6) AS unique_rate, round(max(n) / sum(n), 6) AS top1_ratio, arg_min(txt, (-n, v IS NULL, v)) AS top1_value"


@_query(
    "overview_dq",
    f"""WITH {DIRTY_SQL}, {_melted(["price_dirty", "qty_dirty"], "d")}, {_melted(["flag_dirty"], "d", kind="VARCHAR", name="c")},
a AS (SELECT feature, v, CAST(v AS VARCHAR) AS txt, CAST(count(*) AS DOUBLE) AS n, CASE WHEN v IS NULL OR v = -999 THEN count(*) ELSE 0 END AS gone, coalesce(v = 0, false) AS zero FROM m GROUP BY feature, v),
b AS (SELECT feature, v, v AS txt, CAST(count(*) AS DOUBLE) AS n, CASE WHEN v IS NULL OR v = 'unknown' THEN count(*) ELSE 0 END AS gone, false AS zero FROM c GROUP BY feature, v),
t AS (SELECT feature, first(txt) AS top1_value FROM (SELECT feature, txt, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v NULLS LAST) AS k FROM a UNION ALL SELECT feature, txt, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v NULLS LAST) FROM b) WHERE k = 1 GROUP BY feature),
s AS (SELECT feature, n, gone, zero FROM a UNION ALL SELECT feature, n, gone, zero FROM b)
SELECT s.feature, round(sum(gone) / sum(n), 6) AS missing_rate, round(sum(CASE WHEN zero THEN n ELSE 0 END) / sum(n), 6) AS zeros_rate, round(count(*) / sum(n), 6) AS unique_rate, round(max(n) / sum(n), 6) AS top1_ratio, first(top1_value) AS top1_value
FROM s JOIN t ON s.feature = t.feature GROUP BY s.feature""",
)
def overview_dq(spark, sf):
    config = overview.ProfileConfig(stat_metrics=(), missing=ROLES.missing, special=ROLES.special)
    out = overview.overview(_dirty(spark, sf), ["price_dirty", "qty_dirty", "flag_dirty"], config).drop("dtype")
    return _rounded(out, "missing_rate", "zeros_rate", "unique_rate", "top1_ratio")


@_query(
    "overview_quantiles",
    f"WITH {DIRTY_SQL}, {_melted(['price_dirty', 'qty_dirty', 'l_tax'], 'd')}, o AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS k FROM m WHERE {_CLEAN})"
    f" SELECT feature, {_QUANTILE.format(q=0.25)} AS p25, median(v) AS median, {_QUANTILE.format(q=0.75)} AS p75 FROM o GROUP BY feature",
)
def overview_quantiles(spark, sf):
    return overview.quantiles(_dirty(spark, sf), ["price_dirty", "qty_dirty", "l_tax"], ROLES, overview.QUANTILES).select("feature", "p25", "median", "p75")


@_query(
    "overview_shape",
    f"WITH {DIRTY_SQL}, {_melted(['price_dirty', 'qty_dirty', 'l_tax'], 'd')}, c AS (SELECT feature, v, avg(v) OVER (PARTITION BY feature) AS mu FROM m WHERE {_CLEAN})"
    " SELECT feature, round(sum(v), 2) AS sum, round(stddev_samp(v), 6) AS std, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) AS skew, round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3, 6) AS kurtosis FROM c GROUP BY feature",
)
def overview_shape(spark, sf):
    out = overview.moments(_dirty(spark, sf), ["price_dirty", "qty_dirty", "l_tax"], ROLES, ("sum", "std", "skew", "kurtosis"))
    return _rounded(out.select("feature", F.round("sum", 2).alias("sum"), "std", "skew", "kurtosis"), "std", "skew", "kurtosis")


_CATEGORIES = ["o_orderstatus", "o_orderpriority"]


@_query(
    "top1_value",
    f"WITH {_melted(_CATEGORIES, 'orders', kind='VARCHAR')}, f AS (SELECT feature, v, count(*) AS n FROM m GROUP BY feature, v), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v NULLS LAST) AS k, sum(n) OVER (PARTITION BY feature) AS t FROM f)"
    " SELECT feature, v AS top1_value, round(n / t, 6) AS top1_ratio FROM r WHERE k = 1",
)
def top1_value(spark, sf):
    out = overview.counts(_table(spark, sf, "orders"), _CATEGORIES, Sentinels(), False)
    return out.select("feature", "top1_value", F.round("top1", 6).alias("top1_ratio"))


@_query("unique_rate", f"WITH {_melted([*_CATEGORIES, 'o_orderdate', 'o_totalprice'], 'orders', kind='VARCHAR')} SELECT feature, round(count(DISTINCT v) / count(*), 6) AS unique_rate FROM m GROUP BY feature")
def unique_rate(spark, sf):
    out = overview.counts(_table(spark, sf, "orders"), [*_CATEGORIES, "o_orderdate", "o_totalprice"], Sentinels(), False)
    return out.select("feature", F.round("unique", 6).alias("unique_rate"))


@_query("approx_unique", f"WITH {_melted(MEASURES, 'lineitem')}, u AS (SELECT feature, count(DISTINCT v) AS n FROM m GROUP BY feature) SELECT feature, CAST(n AS BIGINT) AS distinct_values, true AS sketch_is_close FROM u")
def approx_unique(spark, sf):
    """The sketch's estimate, held against the exact number: within three of its standard errors."""
    df = _table(spark, sf, "lineitem")
    sketch = overview.approximate_unique(df, MEASURES, error=0.02)
    exact = overview.counts(df, MEASURES, Sentinels(), True).select("feature", F.col("unique").alias("exact"), F.round(F.col("unique") * F.col("rows")).cast("long").alias("distinct_values"))
    return sketch.join(exact, "feature").select("feature", "distinct_values", (F.abs(F.col("unique") - F.col("exact")) <= 0.06 * F.col("exact")).alias("sketch_is_close"))


def _spark_sql(melted: str, features: list[str], clean: str, bins: int = 8) -> str:
    """CTE ``sparks`` (feature, distribution) from the CTE ``melted`` (feature, v)."""
    names = ", ".join(f"('{f}')" for f in features)
    return f"""ends AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM {melted} WHERE {clean} GROUP BY feature),
placed AS (SELECT m.feature, lo = hi AS flat, least({bins - 1}, greatest(0, CAST(ceil((v - lo) / nullif(hi - lo, 0) * {bins}) AS INT) - 1)) AS bin FROM {melted} m JOIN ends USING (feature) WHERE {clean}),
bars AS (SELECT feature, bin, bool_or(flat) AS flat, count(*) AS n FROM placed GROUP BY feature, bin),
glyphs AS (SELECT feature, bin, flat, substr('▂▃▄▅▆▇█', CAST(floor(n / max(n) OVER (PARTITION BY feature) * 6) AS INT) + 1, 1) AS glyph FROM bars),
sparks AS (SELECT f.feature, CASE WHEN bool_or(g.flat) THEN '____█____' ELSE string_agg(coalesce(g.glyph, '_'), '' ORDER BY i) END AS distribution FROM (VALUES {names}) f(feature) CROSS JOIN range({bins}) r(i) LEFT JOIN glyphs g ON g.feature = f.feature AND g.bin = i GROUP BY f.feature)"""


_PROFILED = ["price_dirty", "qty_dirty", "l_tax"]


@_query(
    "overview_profile",
    f"""WITH {DIRTY_SQL}, {_melted(_PROFILED, "d")}, {_melted(["flag_dirty"], "d", kind="VARCHAR", name="c")}, {_spark_sql("m", _PROFILED, _CLEAN)},
a AS (SELECT feature, CAST(v AS VARCHAR) AS txt, CAST(count(*) AS DOUBLE) AS n, v IS NULL OR v = -999 AS gone, coalesce(v = 0, false) AS zero, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, v NULLS LAST) AS k FROM m GROUP BY feature, v
    UNION ALL SELECT feature, v, count(*), v IS NULL OR v = 'unknown', false, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, v NULLS LAST) FROM c GROUP BY feature, v),
q AS (SELECT feature, round(sum(CASE WHEN gone THEN n ELSE 0 END) / sum(n), 6) AS missing_rate, round(sum(CASE WHEN zero THEN n ELSE 0 END) / sum(n), 6) AS zeros_rate, round(count(*) / sum(n), 6) AS unique_rate, round(max(n) / sum(n), 6) AS top1_ratio, max(CASE WHEN k = 1 THEN txt END) AS top1_value FROM a GROUP BY feature),
o AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS k, avg(v) OVER (PARTITION BY feature) AS mu FROM m WHERE {_CLEAN}),
t AS (SELECT feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, {_QUANTILE.format(q=0.25)} AS p25, median(v) AS median, {_QUANTILE.format(q=0.75)} AS p75, max(v) AS max,
    round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) AS skew, round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3, 6) AS kurtosis FROM o GROUP BY feature)
SELECT q.feature, CASE q.feature WHEN 'flag_dirty' THEN 'string' WHEN 'qty_dirty' THEN 'bigint' ELSE 'double' END AS dtype, distribution, missing_rate, zeros_rate, unique_rate, top1_ratio, top1_value, mean, std, min, p25, median, p75, max, skew, kurtosis
FROM q LEFT JOIN t ON q.feature = t.feature LEFT JOIN sparks s ON q.feature = s.feature""",
)
def overview_profile(spark, sf):
    from gneiss.operators.profile import Profiler

    out = Profiler(_dirty(spark, sf), ["price_dirty", "qty_dirty", "flag_dirty", "l_tax"], missing=ROLES.missing, special=ROLES.special).profile().overview
    return _rounded(out, "missing_rate", "zeros_rate", "unique_rate", "top1_ratio", "std", "skew", "kurtosis").withColumn("mean", F.round("mean", 4))


_DRAWN = ["value", "user_id"]


@_query("sparkline", f"WITH {_melted(_DRAWN, 'events')}, {_spark_sql('m', _DRAWN, 'v IS NOT NULL')} SELECT feature, distribution FROM sparks")
def sparkline(spark, sf):
    return overview.sparklines(_table(spark, sf, "events"), _DRAWN)


# ---- trends by ship month

_TREND = ["price_dirty", "qty_dirty"]
_BOTH = f"{DIRTY_SQL}, {_melted(_TREND, 'd', 'ship_month')}, x AS (SELECT feature, CAST(ship_month AS VARCHAR) AS grp, false AS is_total, v FROM m UNION ALL SELECT feature, NULL, true, v FROM m)"
_SIMPLE = {
    "missing": "avg(CASE WHEN v IS NULL OR v = -999 THEN 1.0 ELSE 0 END)",
    "zeros": "avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END)",
    "unique": "(count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END)) / count(*)",
    "mean": f"avg(CASE WHEN {_CLEAN} THEN v END)",
    "std": f"stddev_samp(CASE WHEN {_CLEAN} THEN v END)",
    "sum": f"sum(CASE WHEN {_CLEAN} THEN v END)",
    "min": f"min(CASE WHEN {_CLEAN} THEN v END)",
    "max": f"max(CASE WHEN {_CLEAN} THEN v END)",
    "median": f"median(CASE WHEN {_CLEAN} THEN v END)",
}


def _trend(spark, sf, metric, digits=6):
    config = overview.ProfileConfig(missing=ROLES.missing, special=ROLES.special)
    out = overview.trend(_dirty(spark, sf), _TREND, metric, F.col("ship_month"), config)
    return out.withColumn("value", F.round("value", digits))


for _m, _e in _SIMPLE.items():
    _query(f"trend_{_m}", f"WITH {_BOTH} SELECT feature, grp, is_total, round({_e}, 6) AS value FROM x GROUP BY feature, grp, is_total")(lambda spark, sf, m=_m: _trend(spark, sf, m))

for _m, _q in (("p25", 0.25), ("p75", 0.75)):
    _query(
        f"trend_{_m}",
        f"WITH {_BOTH}, o AS (SELECT *, row_number() OVER (PARTITION BY feature, grp, is_total ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature, grp, is_total) AS k FROM x WHERE {_CLEAN})"
        f" SELECT feature, grp, is_total, round({_QUANTILE.format(q=_q)}, 6) AS value FROM o GROUP BY feature, grp, is_total",
    )(lambda spark, sf, m=_m: _trend(spark, sf, m))

_query("trend_top1", f"WITH {_BOTH}, f AS (SELECT feature, grp, is_total, v, count(*) AS n FROM x GROUP BY feature, grp, is_total, v) SELECT feature, grp, is_total, round(max(n) / sum(n), 6) AS value FROM f GROUP BY feature, grp, is_total")(lambda spark, sf: _trend(spark, sf, "top1"))

for _m in ("skew", "kurtosis"):
    _p, _s = (3, "/ pow(avg(pow(v - mu, 2)), 1.5)") if _m == "skew" else (4, "/ pow(avg(pow(v - mu, 2)), 2) - 3")
    _query(
        f"trend_{_m}",
        f"WITH {_BOTH}, c AS (SELECT *, avg(v) OVER (PARTITION BY feature, grp, is_total) AS mu FROM x WHERE {_CLEAN}) SELECT feature, grp, is_total, round(CASE WHEN avg(pow(v - mu, 2)) > 0 THEN avg(pow(v - mu, {_p})) {_s} END, 5) AS value FROM c GROUP BY feature, grp, is_total",
    )(lambda spark, sf, m=_m: _trend(spark, sf, m, 5))


@_query(
    "trend_stability",
    f"WITH {_BOTH}, t AS (SELECT feature, grp, is_total, {_SIMPLE['mean']} AS value FROM x GROUP BY feature, grp, is_total)"
    " SELECT feature, round(coalesce(avg(value), 0), 4) AS group_mean, round(coalesce(var_samp(value), 0), 3) AS group_var, round(coalesce(stddev_samp(value) / (abs(avg(value)) + 1e-9), 0), 6) AS group_cv FROM t WHERE NOT is_total GROUP BY feature",
)
def trend_stability(spark, sf):
    config = overview.ProfileConfig(missing=ROLES.missing, special=ROLES.special)
    out = overview.stability(overview.trend(_dirty(spark, sf), _TREND, "mean", F.col("ship_month"), config))
    return out.select("feature", F.round("group_mean", 4).alias("group_mean"), F.round("group_var", 3).alias("group_var"), F.round("group_cv", 6).alias("group_cv"))


_MONTHS = [f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in range(1, 13) if (y, m) < (2001, 12)]


@_query(
    "trend_pivot",
    f"WITH {_BOTH}, t AS (SELECT feature, grp, is_total, round({_SIMPLE['mean']}, 6) AS value FROM x GROUP BY feature, grp, is_total) SELECT feature, "
    + ", ".join(f"max(CASE WHEN grp = '{m}' THEN value END) AS \"{m}\"" for m in _MONTHS)
    + ", max(CASE WHEN is_total THEN value END) AS total, round(coalesce(avg(value) FILTER (NOT is_total), 0), 4) AS group_mean, round(coalesce(var_samp(value) FILTER (NOT is_total), 0), 3) AS group_var,"
    " round(coalesce(stddev_samp(value) FILTER (NOT is_total) / (abs(avg(value) FILTER (NOT is_total)) + 1e-9), 0), 6) AS group_cv FROM t GROUP BY feature",
)
def trend_pivot(spark, sf):
    out = overview.pivoted(_trend(spark, sf, "mean"), with_stability=True)
    return out.withColumns({"group_mean": F.round("group_mean", 4), "group_var": F.round("group_var", 3), "group_cv": F.round("group_cv", 6)})


# ---- dates

_NOTATIONS = {"compact": ("yyyyMMdd", "%Y%m%d"), "dashes": ("yyyy-MM-dd", "%Y-%m-%d"), "slashes": ("yyyy/MM/dd", "%Y/%m/%d"), "dots": ("yyyy.MM.dd", "%Y.%m.%d")}


def _date_query(name: str, grain: str, sql: str):
    @_query(f"date_{name}", f"SELECT event_id, CAST({sql} AS DATE) AS {name} FROM events")
    def run(spark, sf):
        df = _table(spark, sf, "events")
        return dates.with_grain(df, "ts", grain, name).select("event_id", name)


_date_query("day", "day", "ts")
_date_query("week", "week", "date_trunc('week', ts)")
_date_query("month", "month", "date_trunc('month', ts)")


@_query("date_smart_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS compact, CAST(o_orderdate AS DATE) AS dashes, CAST(o_orderdate AS DATE) AS slashes, CAST(o_orderdate AS DATE) AS dots, CAST(o_orderdate AS DATE) AS whole, CAST(NULL AS DATE) AS nothing FROM orders")
def date_smart_parse(spark, sf):
    df = _table(spark, sf, "orders")
    texts = df.select("o_orderkey", *[F.date_format("o_orderdate", j).alias(n) for n, (j, _) in _NOTATIONS.items()], F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("whole"), F.lit("no date").alias("nothing"))
    return texts.select("o_orderkey", *[dates.parse_date(F.col(c), texts.schema[c].dataType).alias(c) for c in texts.columns[1:]])


@_query("date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y.%m in %d') AS shown FROM orders")
def date_format(spark, sf):
    df = _table(spark, sf, "orders")
    return df.select("o_orderkey", dates.format_date(F.col("o_orderdate"), df.schema["o_orderdate"].dataType, "%Y.%m in %d").alias("shown"))


# ---- bins

def _ranked(features: list[str], clean: str = "v IS NOT NULL") -> str:
    return f"{_melted(features, 'd')}, o AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS k FROM m WHERE {clean})"


def _cut_sql(n: int, features: list[str], clean: str = "v IS NOT NULL") -> str:
    """Distinct quantile cuts by feature."""
    return f"{_ranked(features, clean)}, q AS (SELECT i / {n}.0 AS q FROM range(1, {n}) t(i)), cuts AS (SELECT DISTINCT o.feature, o.v AS cut FROM o JOIN q ON o.r = CAST(round((o.k - 1) * q.q) AS BIGINT))"


def _index_sql(feature: str, cut_table: str = "cuts") -> str:
    return f"CAST((SELECT count(*) FROM {cut_table} WHERE {cut_table}.feature = '{feature}' AND {cut_table}.cut <= d.{feature}) AS SMALLINT)"


_BINNED = ["l_quantity", "l_extendedprice", "l_discount"]
_INDEXED = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_index_sql(f)} AS {f}_bin" for f in _BINNED) + " FROM d"


@_query("bin_quantile_index", f"WITH d AS (SELECT * FROM lineitem), {_cut_sql(5, _BINNED)} {_INDEXED}")
def bin_quantile_index(spark, sf):
    df = _table(spark, sf, "lineitem")
    return binning.fit(df, _BINNED, "quantile", 5).transform(df).select("l_orderkey", "l_linenumber", *[f"{f}_bin" for f in _BINNED])


def _uniform_sql(n: int, feature: str, table: str = "d") -> str:
    return f"SELECT '{feature}' AS feature, lo + (hi - lo) * i / {n}.0 AS cut FROM (SELECT min({feature}) AS lo, max({feature}) AS hi FROM {table}), range(1, {n}) t(i)"


@_query("bin_uniform_index", "WITH d AS (SELECT * FROM lineitem), cuts AS (" + " UNION ALL ".join(_uniform_sql(6, f) for f in _BINNED) + f") {_INDEXED}")
def bin_uniform_index(spark, sf):
    df = _table(spark, sf, "lineitem")
    return binning.fit(df, _BINNED, "uniform", 6).transform(df).select("l_orderkey", "l_linenumber", *[f"{f}_bin" for f in _BINNED])


@_query("bin_uniform_few", "WITH d AS (SELECT * FROM lineitem), v AS (SELECT DISTINCT l_discount AS v FROM d), w AS (SELECT v, lead(v) OVER (ORDER BY v) AS u FROM v), cuts AS (SELECT 'l_discount' AS feature, (v + u) / 2 AS cut FROM w WHERE u IS NOT NULL) SELECT l_discount, CAST(count(*) AS BIGINT) AS n, " + _index_sql("l_discount") + " AS bin FROM d GROUP BY l_discount")
def bin_uniform_few(spark, sf):
    df = _table(spark, sf, "lineitem")
    out = binning.fit(df, ["l_discount"], "uniform", 20).transform(df)
    return out.groupBy("l_discount", F.col("l_discount_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "bin_uniform_pruned",
    "WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN l_quantity * 10 ELSE l_quantity END AS gap FROM lineitem), raw AS (" + _uniform_sql(12, "gap") + "), b AS (SELECT DISTINCT (SELECT count(*) FROM raw WHERE cut <= d.gap) AS i FROM d), k AS (SELECT cut, row_number() OVER (ORDER BY cut) - 1 AS i FROM raw), cuts AS (SELECT 'gap' AS feature, cut FROM k WHERE i IN (SELECT i FROM b))"
    " SELECT l_orderkey, l_linenumber, " + _index_sql("gap") + " AS gap_bin FROM d",
)
def bin_uniform_pruned(spark, sf):
    df = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, F.col("l_quantity") * 10).otherwise(F.col("l_quantity")).alias("gap"))
    return binning.fit(df, ["gap"], "uniform", 12, drop_empty=True).transform(df).drop("gap")


_DIRTY_INDEX = f"WITH {DIRTY_SQL}, {_cut_sql(4, ['price_dirty', 'qty_dirty'], _CLEAN)}, i AS (SELECT *, CASE WHEN price_dirty IS NULL OR price_dirty = -999 THEN -1 WHEN price_dirty = -1 THEN -3 WHEN price_dirty = -998 THEN -4 ELSE {_index_sql('price_dirty')} END AS price_bin, CASE WHEN qty_dirty IS NULL OR qty_dirty = -999 THEN -1 WHEN qty_dirty = -1 THEN -3 WHEN qty_dirty = -998 THEN -4 ELSE {_index_sql('qty_dirty')} END AS qty_bin FROM d)"


def _dirty_binning(df):
    return binning.fit(df, ["price_dirty", "qty_dirty"], "quantile", 4, sentinels=ROLES)


@_query("bin_special_index", f"{_DIRTY_INDEX} SELECT l_orderkey, l_linenumber, CAST(price_bin AS SMALLINT) AS price_bin, CAST(qty_bin AS SMALLINT) AS qty_bin FROM i")
def bin_special_index(spark, sf):
    df = _dirty(spark, sf)
    out = _dirty_binning(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", F.col("price_dirty_bin").alias("price_bin"), F.col("qty_dirty_bin").alias("qty_bin"))


@_query("bin_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN '00_[-inf, 10)' WHEN l_quantity < 25.5 THEN '01_[10, 25.5)' ELSE '02_[25.5, inf)' END AS l_quantity_bin, CASE WHEN l_tax = 0 THEN 'Special_0' WHEN l_tax < 0.05 THEN '00_[-inf, 0.05)' ELSE '01_[0.05, inf)' END AS l_tax_bin FROM lineitem")
def bin_label(spark, sf):
    df = _table(spark, sf, "lineitem")
    rules = {"l_quantity": [10, 25.5], "l_tax": [0.05]}
    return binning.from_rules(rules, sentinels=Sentinels.of((), (0,))).transform(df, "label").select("l_orderkey", "l_linenumber", "l_quantity_bin", "l_tax_bin")


_RULES = [["1-URGENT"], ["2-HIGH", "3-MEDIUM"]]
_CATEGORY_SQL = "SELECT o_orderkey, CAST(CASE WHEN o_orderpriority IS NULL OR o_orderpriority = 'none' THEN -1 WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 1 WHEN o_orderpriority = '5-LOW' THEN -3 ELSE -2 END AS SMALLINT) AS o_orderpriority_bin FROM orders"


def _category(spark, sf, join_above):
    df = _table(spark, sf, "orders")
    rules = binning.from_rules(groups={"o_orderpriority": _RULES}, sentinels=Sentinels.of(("none",), ("5-LOW",)), join_above=join_above)
    return rules.transform(df).select("o_orderkey", "o_orderpriority_bin")


_query("bin_category_index", _CATEGORY_SQL)(lambda spark, sf: _category(spark, sf, 100))
_query("bin_category_join", _CATEGORY_SQL)(lambda spark, sf: _category(spark, sf, 1))

_STATS = f"""{_DIRTY_INDEX}, u AS (SELECT 'price_dirty' AS feature, price_bin AS bin, bad FROM i UNION ALL SELECT 'qty_dirty', qty_bin, bad FROM i),
c AS (SELECT feature, bin, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b FROM u GROUP BY feature, bin),
t AS (SELECT *, n - b AS g, sum(n) OVER w AS tn, sum(b) OVER w AS tb, sum(n - b) OVER w AS tg FROM c WINDOW w AS (PARTITION BY feature)),
s AS (SELECT *, b / (tb + 1e-6) AS bd, g / (tg + 1e-6) AS gd, ln((b / (tb + 1e-6) + 1e-6) / (g / (tg + 1e-6) + 1e-6)) AS woe FROM t),
r AS (SELECT *, sum(bd) OVER k AS cb, sum(gd) OVER k AS cg, (bd - gd) * woe AS iv FROM s WINDOW k AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING))"""


@_query(
    "bin_stats",
    f"{_STATS} SELECT feature || '_bin' AS feature, CAST(bin AS SMALLINT) AS bin_index, CAST(n AS BIGINT) AS count, CAST(b AS BIGINT) AS bad, CAST(g AS BIGINT) AS good, round(n / tn, 6) AS count_dist, round(b / n, 6) AS bad_rate, round(bd, 6) AS bad_dist, round(gd, 6) AS good_dist, round(woe, 6) AS woe, round(iv, 6) AS bin_iv, round(b / n / (tb / tn + 1e-6), 6) AS lift, round(cb, 6) AS cum_bad_dist, round(cg, 6) AS cum_good_dist, round(abs(cb - cg), 6) AS bin_ks, round(sum(iv) OVER (PARTITION BY feature), 6) AS total_iv FROM r",
)
def bin_stats(spark, sf):
    df = _dirty(spark, sf)
    out = _dirty_binning(df).bin_stats(df, "bad").drop("bin_label")
    out = out.withColumns({"bad": F.col("bad").cast("long"), "good": F.col("good").cast("long")})
    return _rounded(out, "count_dist", "bad_rate", "bad_dist", "good_dist", "woe", "bin_iv", "lift", "cum_bad_dist", "cum_good_dist", "bin_ks", "total_iv")


@_query("iv_total", f"{_STATS} SELECT feature, round(sum(iv), 6) AS iv FROM r GROUP BY feature")
def iv_total(spark, sf):
    df = _dirty(spark, sf)
    out = _dirty_binning(df).bin_stats(df, "bad")
    return out.groupBy(F.regexp_replace("feature", "_bin$", "").alias("feature")).agg(F.round(F.max("total_iv"), 6).alias("iv"))


_WOE = f"{_STATS}, z AS (SELECT feature, bin, ln(((b + 1e-6) / (tb + 1e-6)) / ((g + 1e-6) / (tg + 1e-6))) AS woe FROM r)"


@_query("woe_materialized", f"{_WOE} SELECT feature, CAST(bin AS SMALLINT) AS bin, round(woe, 6) AS woe FROM z")
def woe_materialized(spark, sf):
    df = _dirty(spark, sf)
    return _rounded(_dirty_binning(df).woe_table(df, "bad"), "woe")


@_query("woe_transform", f"{_WOE} SELECT l_orderkey, l_linenumber, round(p.woe, 6) AS price_woe, round(q.woe, 6) AS qty_woe FROM i JOIN z p ON p.feature = 'price_dirty' AND p.bin = price_bin JOIN z q ON q.feature = 'qty_dirty' AND q.bin = qty_bin")
def woe_transform(spark, sf):
    df = _dirty(spark, sf)
    out = _dirty_binning(df).with_woes(df, "bad").transform(df, "woe")
    return out.select("l_orderkey", "l_linenumber", F.round("price_dirty_woe", 6).alias("price_woe"), F.round("qty_dirty_woe", 6).alias("qty_woe"))


# ---- ranking metrics

_METRIC = f"""WITH {DIRTY_SQL}, c AS (SELECT l_linenumber AS bin, CAST(count(*) AS BIGINT) AS count, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(1 - bad) AS BIGINT) AS good, avg(bad) AS bad_rate FROM d GROUP BY l_linenumber),
p AS (SELECT *, bad / sum(bad) OVER () AS pct_bad, good / sum(good) OVER () AS pct_good, count / sum(count) OVER () AS pct_total, sum(bad) OVER () / sum(count) OVER () AS o FROM c),
w AS (SELECT *, ln(pct_good / (pct_bad + 1e-10)) AS woe, bad_rate / (o + 1e-10) AS lift, sum(pct_bad) OVER (ORDER BY bin) AS cb, sum(pct_good) OVER (ORDER BY bin) AS cg FROM p)"""


@_query("metric_bin_stats", f"{_METRIC} SELECT bin, count, bad, good, round(bad_rate, 6) AS bad_rate, round(pct_bad, 6) AS pct_bad, round(pct_good, 6) AS pct_good, round(pct_total, 6) AS pct_total, round(woe, 6) AS woe, round(lift, 6) AS lift, round((pct_good - pct_bad) * woe, 8) AS iv_contribution, round(cb, 6) AS cum_pct_bad, round(cg, 6) AS cum_pct_good, round(abs(cb - cg), 6) AS ks_spread FROM w")
def metric_bin_stats(spark, sf):
    out = ranking.bin_table(_dirty(spark, sf), "l_linenumber", "bad")
    out = _rounded(out, "bad_rate", "pct_bad", "pct_good", "pct_total", "woe", "lift", "cum_pct_bad", "cum_pct_good", "ks_spread")
    return out.withColumn("iv_contribution", F.round("iv_contribution", 8))


@_query("ks_binned", f"{_METRIC} SELECT round(max(abs(cb - cg)), 6) AS ks FROM w")
def ks_binned(spark, sf):
    return _rounded(ranking.ks_binned(_dirty(spark, sf), "l_linenumber", "bad"), "ks")


def _score_sql(score: str) -> str:
    return f"WITH {DIRTY_SQL}, f AS (SELECT {score} AS s, CAST(sum(bad) AS DOUBLE) AS b, CAST(sum(1 - bad) AS DOUBLE) AS g FROM d GROUP BY {score}), r AS (SELECT *, sum(b) OVER (ORDER BY s) AS cb, sum(g) OVER (ORDER BY s) AS cg, sum(b) OVER () AS tb, sum(g) OVER () AS tg FROM f)"


for _score in ("l_discount", "l_extendedprice"):
    _query(f"auc_{_score[2:]}", f"{_score_sql(_score)} SELECT round(sum(b * (cg - g + g / 2)) / max(tb * tg), 6) AS auc FROM r")(lambda spark, sf, s=_score: _rounded(ranking.auc(_dirty(spark, sf), F.col(s), F.col("bad")), "auc"))
    _query(f"ks_{_score[2:]}", f"{_score_sql(_score)} SELECT round(max(abs(cb / tb - cg / tg)), 6) AS ks FROM r")(lambda spark, sf, s=_score: _rounded(ranking.ks(_dirty(spark, sf), F.col(s), F.col("bad")), "ks"))


# ---- stability

def _psi_sql(counts: str, skeleton: str, measures: str) -> str:
    """PSI of each group and of all rows, from CTEs ``counts`` (grp, feature, bin, n) and ``skeleton`` (feature, bin)."""
    return f"""WITH {counts}, {skeleton},
b AS (SELECT min(grp) AS base FROM counts), a AS (SELECT grp, false AS is_total, feature, bin, n FROM counts UNION ALL SELECT NULL, true, feature, bin, sum(n) FROM counts GROUP BY feature, bin),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY grp, is_total, feature) AS share FROM a), e AS (SELECT feature, bin, share FROM s, b WHERE grp = base), g AS (SELECT DISTINCT grp, is_total FROM s),
x AS (SELECT k.feature, g.grp, g.is_total, coalesce(s.share, 1e-6) AS a, coalesce(e.share, 1e-6) AS e FROM skeleton k CROSS JOIN g LEFT JOIN s ON s.feature = k.feature AND s.bin = k.bin AND s.is_total = g.is_total AND s.grp IS NOT DISTINCT FROM g.grp LEFT JOIN e ON e.feature = k.feature AND e.bin = k.bin),
p AS (SELECT feature, grp, is_total, sum((a - e) * ln(a / e)) AS psi FROM x GROUP BY feature, grp, is_total) {measures}"""


_PSI_NUMERIC = (
    f"{DIRTY_SQL}, {_cut_sql(10, ['price_dirty', 'l_quantity'], _CLEAN)}, counts AS (SELECT ship_month AS grp, 'price_dirty' AS feature, CASE WHEN price_dirty IS NULL OR price_dirty = -999 THEN -1 WHEN price_dirty = -1 THEN -3 WHEN price_dirty = -998 THEN -4 ELSE {_index_sql('price_dirty')} END AS bin, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT ship_month, 'l_quantity', {_index_sql('l_quantity')}, count(*) FROM d GROUP BY ALL)",
    "skeleton AS (SELECT feature, CAST(bin AS BIGINT) AS bin FROM (VALUES ('price_dirty'), ('l_quantity')) f(feature), (SELECT unnest([-1, -3, -4, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS bin))",
)
_SHOWN = "SELECT feature, CAST(grp AS VARCHAR) AS grp, is_total, round(psi, 6) AS psi FROM p"
_GATE = "SELECT feature, round(avg(psi), 6) AS group_mean, round(coalesce(var_samp(psi), 0), 6) AS group_var, round(CASE WHEN max(psi) < 0.05 THEN 0 ELSE coalesce(stddev_samp(psi) / (avg(psi) + 1e-9), 0) END, 6) AS group_cv FROM p WHERE NOT is_total GROUP BY feature"


def _psi(spark, sf):
    return psi.numeric_psi(_dirty(spark, sf), ["price_dirty", "l_quantity"], F.col("ship_month"), 10, sentinels=ROLES)


@_query("psi_numeric", _psi_sql(*_PSI_NUMERIC, _SHOWN))
def psi_numeric(spark, sf):
    return _rounded(_psi(spark, sf).withColumn("grp", F.col("grp").cast("string")), "psi")


@_query("psi_total", _psi_sql(*_PSI_NUMERIC, "SELECT feature, round(psi, 6) AS psi FROM p WHERE is_total"))
def psi_total(spark, sf):
    return _rounded(_psi(spark, sf).where("is_total").select("feature", "psi"), "psi")


@_query("psi_gate", _psi_sql(*_PSI_NUMERIC, _GATE))
def psi_gate(spark, sf):
    return _rounded(psi.psi_stability(_psi(spark, sf)), "group_mean", "group_var", "group_cv")


_PSI_CATEGORY = (f"{DIRTY_SQL}, {_melted(['flag_dirty', 'l_linestatus'], 'd', 'ship_month', 'VARCHAR')}, counts AS (SELECT ship_month AS grp, feature, coalesce(v, 'Missing') AS bin, count(*) AS n FROM m GROUP BY ALL)", "skeleton AS (SELECT DISTINCT feature, bin FROM counts)")


@_query("psi_categorical", _psi_sql(*_PSI_CATEGORY, _SHOWN))
def psi_categorical(spark, sf):
    out = psi.categorical_psi(_dirty(spark, sf), ["flag_dirty", "l_linestatus"], F.col("ship_month"))
    return _rounded(out.withColumn("grp", F.col("grp").cast("string")), "psi")


# ---- frequencies and fitted cuts

@_query("frequency_table", f"WITH {_melted(['l_returnflag', 'l_linestatus'], 'lineitem', kind='VARCHAR')} SELECT feature, v AS value, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY feature, v")
def frequency_table(spark, sf):
    return frequencies(melt(_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], numeric=False), ["feature"])


@_query("bin_counts", f"{_STATS} SELECT feature, CAST(bin AS SMALLINT) AS bin, CAST(n AS BIGINT) AS n, CAST(b AS BIGINT) AS bad FROM c")
def bin_counts(spark, sf):
    df = _dirty(spark, sf)
    return _dirty_binning(df).long_counts(df, F.col("bad")).withColumn("bad", F.col("bad").cast("long"))


def _cut_rows(spark, fitted):
    rows = [(f, i, c) for f, cuts in fitted.cuts.items() for i, c in enumerate(cuts[1:-1])]
    return spark.createDataFrame(rows, "feature string, position int, cut double")


def _fit_target(df):
    return df.withColumn("late", (F.col("l_quantity") + 20 * F.col("l_discount") * 10 > 35).cast("int"))


@_query("cart_cuts")
def cart_cuts(spark, sf):
    df = _fit_target(_table(spark, sf, "lineitem"))
    return _cut_rows(spark, binning.fit(df, ["l_quantity", "l_discount", "l_extendedprice"], "cart", 5, target="late"))


@_query("optimal_numeric")
def optimal_numeric(spark, sf):
    df = _fit_target(_table(spark, sf, "lineitem"))
    return _cut_rows(spark, binning.fit_optimal(df, "late", ["l_quantity", "l_discount", "l_extendedprice"]))


@_query("optimal_categorical")
def optimal_categorical(spark, sf):
    df = _table(spark, sf, "part").withColumn("big", (F.col("p_size") > 25).cast("int"))
    groups = binning.fit_optimal(df, "big", ["p_brand", "p_type"], ["p_brand", "p_type"]).groups
    rows = [(f, i, v) for f, gs in groups.items() for i, g in enumerate(gs) for v in g]
    return spark.createDataFrame(rows, "feature string, bin int, category string")
