import datetime
import math
import warnings
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.errors import BadType
from gneiss.functions import dates
from gneiss.functions.values import Sentinels, pick_features
from gneiss.operators import overview, psi, ranking
from gneiss.operators.profile import Profiler
from gneiss.plans.longform import frequencies, melt, order_statistics
from gneiss.sources import frames


@pytest.fixture(scope="module")
def scenario(spark):
    rnd = np.random.default_rng(42)
    n = 4000
    month = np.repeat(["202401", "202402", "202403", "202404"], n // 4)
    last = month == "202404"
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "month": month,
                "good": rnd.normal(100, 10, n),
                "high_missing": np.where(rnd.random(n) < 0.6, -999.0, rnd.normal(0, 1, n)),
                "user": [f"u{i}" for i in range(n)],
                "quasi": (rnd.random(n) < 0.005).astype(float),
                "drift": np.where(last, rnd.normal(5, 1, n), rnd.normal(0, 1, n)),
                "special": np.where(rnd.random(n) < np.where(last, 0.5, 0.01), -1.0, rnd.normal(3, 1, n)),
            }
        )
    )


def test_scenario(spark, scenario):
    features = ["good", "high_missing", "quasi", "drift", "special", "month"]
    report = Profiler(scenario, features, missing=[-999, "none"], special=[-1]).profile("month", stat_metrics=("mean", "p25"))
    rows = {r["feature"]: r for r in report.overview.collect()}
    assert rows["high_missing"]["missing_rate"] > 0.5 and rows["quasi"]["top1_ratio"] > 0.99
    assert report.overview.columns[:8] == ["feature", "dtype", "distribution", "missing_rate", "zeros_rate", "unique_rate", "top1_ratio", "top1_value"]
    assert rows["month"]["dtype"] == "string" and rows["month"]["mean"] is None
    stable = {r["feature"]: r for r in report.stats["psi"].collect()}
    assert stable["drift"]["total"] > 0.25 and stable["special"]["total"] > 0.1 and "month" not in stable
    assert stable["good"]["202401"] == pytest.approx(0) and stable["good"]["group_cv"] == 0
    assert report.stats["mean"].columns == ["feature", "202401", "202402", "202403", "202404", "total", "group_mean", "group_var", "group_cv"]
    assert report.dq["missing"].columns == ["feature", "202401", "202402", "202403", "202404", "total"]
    with pytest.raises(ValueError):
        report.show_trend("nothing")
    with pytest.raises(ValueError):
        report.show_dq("nothing")
    assert "drift" in report.show_trend("psi") and "%" in report.show_dq("missing") and "<h3>" in report._repr_html_()


def test_report_as_workbook(spark, scenario, tmp_path):
    report = Profiler(scenario, ["good", "month"]).profile("month", stat_metrics=("mean",), sparkline=False)
    assert report.write_excel(str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        assert all(f'name="{n}"' in book for n in ("Overview", "DQ_missing", "Trend_Mean", "Trend_Psi"))
        assert any("colorScale" in z.read(n).decode() for n in z.namelist() if "sheet" in n) and any("dataBar" in z.read(n).decode() for n in z.namelist() if "sheet" in n)
    assert not report.write_excel(str(tmp_path / "no" / "r.xlsx"))
    a, b, c = report.data("pandas")
    assert isinstance(a, pd.DataFrame) and set(b) == set(overview.DQ) and isinstance(c["psi"], pd.DataFrame)


def test_profile_by_calendar(spark):
    df = spark.createDataFrame([(f"2024{m:02d}15", float(m * i)) for m in (1, 2) for i in range(50)], "day string, x double")
    report = Profiler(df, ["x"]).profile("month", date_column="day", stat_metrics=("mean",), sparkline=False)
    assert "2024-01-01" in report.stats["mean"].columns
    with pytest.raises(ValueError):
        Profiler(df, ["x"]).profile("month", date_column="none")
    with pytest.raises(ValueError):
        Profiler(df, ["x"]).profile("none")


def test_rates_count_nulls_and_nan(spark):
    df = spark.createDataFrame([(None, "a"), (math.nan, None), (0.0, "a"), (-1.0, "N"), (5.0, None)], "x double, s string")
    s = Sentinels.of((-1, "N"), ())
    x = overview.counts(df, ["x"], s, True).first()
    assert (x["missing"], x["zeros"], x["unique"], x["top1"]) == (0.4, 0.2, 1.0, 0.2)
    t = overview.counts(df, ["s"], s, False).first()
    assert (t["missing"], t["zeros"], t["unique"], t["top1"], t["top1_value"]) == (0.6, 0.0, 0.6, 0.4, "a")
    m = overview.moments(df, ["x"], s, ("min", "max")).first()
    assert (m["min"], m["max"]) == (0.0, 5.0)
    empty = overview.overview(df.limit(0), ["x", "s"]).collect()
    assert [r["feature"] for r in empty] == ["x", "s"]


@pytest.mark.parametrize("spread", [1, 4, 32])
def test_order_statistics_are_nearest_rank(spark, spread):
    rnd = np.random.default_rng(3)
    values = {"a": np.round(rnd.normal(0, 1, 501), 1), "b": rnd.random(501)}
    df = spark.createDataFrame(pd.DataFrame(values))
    freq = frequencies(melt(df, ["a", "b"]), ["feature"])
    q = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["feature"], r["q"]): r["value"] for r in order_statistics(freq, ["feature"], q, spread).collect()}
    assert got == {(f, p): np.sort(v)[int(np.floor(500 * p + 0.5))] for f, v in values.items() for p in q}


def test_sparklines(spark):
    df = spark.createDataFrame([(7.0, None, float(i), 0.0 if i < 90 else 1.0) for i in range(100)], "const double, none double, even double, low double")
    got = {r["feature"]: r["distribution"] for r in overview.sparklines(df, df.columns).collect()}
    assert got["const"] == "____█____" and got["none"] == "_" * 8 and len(got["even"]) == 8 and set(got["even"]) <= set("▆▇█") and got["low"] == "█______▂"


@pytest.mark.parametrize("seed", range(3))
def test_auc_and_ks_against_pairs(spark, seed):
    rnd = np.random.default_rng(seed)
    x, y = rnd.integers(0, 20, 300) / 10, rnd.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (math.nan, 0), (1.0, None)], "s double, y int")
    bad, good = x[y == 1], x[y == 0]
    want = ((bad[:, None] > good).sum() + 0.5 * (bad[:, None] == good).sum()) / len(bad) / len(good)
    assert ranking.auc(df, F.col("s"), F.col("y")).first()[0] == pytest.approx(want)
    assert ranking.auc(df, -F.col("s"), F.col("y")).first()[0] == pytest.approx(1 - want)
    gap = max(abs((bad <= t).mean() - (good <= t).mean()) for t in np.unique(x))
    assert ranking.ks(df, F.col("s"), F.col("y")).first()[0] == pytest.approx(gap)
    assert ranking.auc(df.where("y = 1"), F.col("s"), F.col("y")).first()[0] == 0.5
    assert ranking.auc(df.limit(0), F.col("s"), F.col("y")).first()[0] == 0.5


def test_bin_table_of_one_class(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, 0), (2, None)], "b int, y int")
    rows = {r["bin"]: r for r in ranking.bin_table(df, "b", "y").collect()}
    assert rows[0]["woe"] == -math.inf and rows[2]["count"] == 2 and rows[2]["bad_rate"] == 0.0
    assert all(r["pct_good"] is None for r in ranking.bin_table(df.where("y = 1"), "b", "y").collect())
    assert [r["bin"] for r in ranking.bin_table(df, "b", "y", ascending=False).collect()] == [2, 1, 0]


def test_psi_of_equal_groups_is_zero(spark):
    df = spark.createDataFrame([(g, float(i), c) for g in ("a", "b", None) for i, c in enumerate("xyzxyzxy")], "g string, v double, c string")
    for r in psi.psi(df, ["v", "c"], F.col("g"), 4).collect():
        assert abs(r["psi"]) < 1e-12 and (r["grp"] is not None or r["is_total"])
    gone = spark.createDataFrame([("a", "x"), ("b", None)], "g string, c string")
    rows = {(r["grp"], r["is_total"]): r["psi"] for r in psi.categorical_psi(gone, ["c"], F.col("g")).collect()}
    assert rows["b", False] == pytest.approx(2 * (1 - 1e-6) * math.log(1e6))


def test_dates(spark):
    df = spark.createDataFrame([("20250105", 20250105), ("2025-01-05", 2025015), ("2025/01/05", 20251399), ("2025.01.05", None), ("nothing", 0), (None, 1)], "s string, n int")
    d = datetime.date(2025, 1, 5)
    rows = df.select(dates.parse_date(F.col("s"), df.schema["s"].dataType).alias("s"), dates.parse_date(F.col("n"), df.schema["n"].dataType).alias("n")).collect()
    assert [r["s"] for r in rows] == [d, d, d, d, None, None] and [r["n"] for r in rows] == [d, None, None, None, None, None]
    week = df.limit(1).select(dates.to_week(F.col("s"), df.schema["s"].dataType), dates.to_month(F.col("s"), df.schema["s"].dataType), dates.format_date(F.col("s"), df.schema["s"].dataType, "%d o'clock %Y%%")).first()
    assert week[0] == datetime.date(2024, 12, 30) and week[1] == datetime.date(2025, 1, 1) and week[2] == "05 o'clock 2025%"
    with pytest.raises(ValueError):
        dates.java_pattern("%Q")
    with pytest.raises(ValueError):
        dates.with_grain(df, "s", "year", "y")


def test_frames(spark):
    assert frames.as_frame(spark, pd.DataFrame({"a": [1, 2]})).count() == 2
    with pytest.raises(BadType):
        frames.as_frame(spark, [1, 2])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        frames.as_frame(spark, pd.DataFrame({"a": ["1", "2.5"], "b": ["x", "1"]}))
    assert any("a" in str(w.message) and "b" not in str(w.message).split(":")[1] for w in seen if w.category is UserWarning)
    df = spark.range(1000)
    assert frames.sample_rows(df, 10).count() == 10 and 50 < frames.sample_share(df, 0.1).count() < 150
    with pytest.raises(ValueError):
        frames.sample_share(df, 1.5)
    assert pick_features(spark.createDataFrame([(1, "a", 1.0, True)], "i int, s string, d double, b boolean"), kinds=[int, float], exclude=["d"]) == ["i"]
    with pytest.raises(ValueError):
        pick_features(df, ["none"])


def test_sparklines_count_all_rows(spark):
    n = 1_000_000
    x = F.when(F.col("id") == 17, -900.0).when(F.col("id") == n - 5, 900.0).otherwise(F.col("id") % 7)
    df = spark.range(n).select(*[F.when(F.col("id") == 100 * i + 3, 10.0 ** (i + 3)).otherwise(x).alias(f"x{i}") for i in range(6)])
    got = {r["feature"]: r["distribution"] for r in overview.sparklines(df, df.columns).collect()}
    assert got == {"x0": "▂__█___▂", "x1": "█▂_____▂"} | {f"x{i}": "█______▂" for i in range(2, 6)}


def test_profile_by_flags_large_numbers_and_a_group_named_total(spark):
    df = spark.createDataFrame(pd.DataFrame({"flag": [True, False, True, False], "big": [1e20, 1e20, 2.5, 2.5], "word": ["total", "x", "total", "x"], "v": [1.0, 2.0, 3.0, 4.0]}))
    for by, want in (("flag", {"true": 2.0, "false": 3.0}), ("big", {"1.0E20": 1.5, "2.5": 3.5}), ("word", {"total (group)": 2.0, "x": 3.0})):
        report = Profiler(df, ["v"]).profile(by)
        (row,) = report.stats["mean"].collect()
        assert {k: row[k] for k in want} == want and row["total"] == 2.5
        (row,) = report.dq["missing"].collect()
        assert row["total"] == 0 and all(row[k] == 0 for k in want)


def test_profile_of_pandas_and_odd_names(spark):
    report = Profiler(pd.DataFrame({"a.b": ["p", "q", "p"], "v": [1, 2, 4]}), ["v"]).profile("a.b")
    (row,) = report.stats["median"].collect()
    assert (row["p"], row["q"], row["total"]) == (2.5, 2.0, 2.0)


def test_median_by_ranks(spark):
    rnd = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rnd.integers(0, 50, 1001).astype(float), "b": rnd.random(1001), "g": rnd.integers(0, 3, 1001)})
    out = overview.quantiles(spark.createDataFrame(frame), ["a", "b"], Sentinels(), overview.QUANTILES, F.col("g")).collect()
    for r in out:
        part = frame if r.is_total else frame[frame["g"] == int(r.grp)]
        assert r["median"] == part[r.feature].median()
        v = np.sort(part[r.feature].to_numpy())
        assert r.p25 == v[int(math.floor((len(v) - 1) * 0.25 + 0.5))]
