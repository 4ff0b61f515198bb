"""A whole profile: overview, trends and stability of all features, as a report."""

from __future__ import annotations

import html
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.dates import GRAINS, with_grain
from gneiss.functions.values import pick_features
from gneiss.operators import overview as ov
from gneiss.operators import psi as psi_ops
from gneiss.plans.longform import split_kinds
from gneiss.session import log, timed
from gneiss.sources.frames import as_frame, formatted, sample_share
from gneiss.sources.xlsx import write_workbook

GRAIN_COLUMN = "_gneiss_grain"
#: Colours of a population stability of 0, 0.1 and 0.25.
PSI_SCALE = ((0, "63BE7B"), (0.1, "FFEB84"), (0.25, "F8696B"))


@dataclass
class Report:
    """Tables of a profile; trends are wide tables with a column for each group."""

    overview: DataFrame
    dq: dict[str, DataFrame] = field(default_factory=dict)
    stats: dict[str, DataFrame] = field(default_factory=dict)
    title: str = "Profile"

    def data(self, kind: str = "spark"):
        """Overview, quality trends and statistic trends."""
        return formatted((self.overview, self.dq, self.stats), kind)

    def show_overview(self) -> str:
        return _table(self.overview.toPandas())

    def show_dq(self, metric: str) -> str:
        if metric not in self.dq:
            raise ValueError(f"no quality metric {metric!r}; there are {sorted(self.dq)}")
        return _table(self.dq[metric].toPandas(), percent=True)

    def show_trend(self, metric: str) -> str:
        if metric not in self.stats:
            raise ValueError(f"no metric {metric!r}; there are {sorted(self.stats)}")
        return _table(self.stats[metric].toPandas(), gradient=(0, 0.5) if metric == "psi" else None)

    def _repr_html_(self) -> str:
        items = "".join(f"<li>{html.escape(kind)}: {html.escape(', '.join(names) or 'none')}</li>" for kind, names in (("quality trends", self.dq), ("statistic trends", self.stats)))
        return f"<div><h3>{html.escape(self.title)}</h3><ul>{items}</ul>{self.show_overview()}</div>"

    def write_excel(self, path: str) -> bool:
        """Sheets Overview, DQ_* and Trend_*; failures are logged and give False."""
        try:
            sheets = {"Overview": (self.overview.toPandas(), {}, {})}
            for m, t in self.dq.items():
                sheets[f"DQ_{m}"] = (t.toPandas(), {}, {})
            for m, t in self.stats.items():
                frame = t.toPandas()
                scales = {c: PSI_SCALE for c in frame.columns if c not in ("feature", "group_mean", "group_var", "group_cv")} if m == "psi" else {}
                sheets[f"Trend_{m.capitalize()}"] = (frame, scales, {"group_cv": (0, 1, "638EC6")})
            write_workbook(path, sheets)
            return True
        except Exception:  # a sheet can fail in many ways, and a report goes on without its workbook
            log.exception("the workbook could not be written")
            return False


def number_format(column: str, percent: bool = False) -> str:
    if percent or "rate" in column or "ratio" in column:
        return "{:.2%}"
    return "{:.4f}" if column in ("group_var", "group_cv") else "{:.2f}"


def _table(frame: pd.DataFrame, percent: bool = False, gradient: tuple | None = None) -> str:
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in frame.columns)
    body = []
    for row in frame.itertuples(index=False, name=None):
        cells = []
        for c, v in zip(frame.columns, row, strict=True):
            style = ' style="font-family:monospace"' if c == "distribution" else ""
            if isinstance(v, float):
                if gradient and c not in ("group_mean", "group_var", "group_cv") and v == v:
                    share = min(1.0, max(0.0, (v - gradient[0]) / (gradient[1] - gradient[0])))
                    style = f' style="background:rgb(255,{round(255 - 150 * share)},{round(255 - 150 * share)})"'
                text = "" if v != v else number_format(str(c), percent and c != "feature").format(v)
            else:
                text = "" if v is None else str(v)
            cells.append(f"<td{style}>{html.escape(text)}</td>")
        body.append(f"<tr>{''.join(cells)}</tr>")
    return f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table>"


class Profiler:
    """Profiles of the features of a table, a Spark, pandas or Arrow one."""

    def __init__(self, table, features=None, *, exclude=None, kinds=None, missing=(), special=(), sample: float | None = None, config: ov.ProfileConfig | None = None):
        df = as_frame(None, table)
        self.df = sample_share(df, sample) if sample is not None else df
        self.features = pick_features(self.df, features, exclude, kinds)
        config = config or ov.ProfileConfig()
        self.config = config.but(missing=tuple(missing) or config.missing, special=tuple(special) or config.special)

    @timed
    def profile(self, by: str | None = None, *, date_column: str | None = None, **changes) -> Report:
        """An overview, and with ``by`` (a column, or day, week or month of ``date_column``) trends and stability."""
        config = self.config.but(**changes)
        df, group = self.df, by
        if by in GRAINS and date_column is not None:
            if date_column not in df.columns:
                raise ValueError(f"no column {date_column!r}")
            df, group = with_grain(df, date_column, by, GRAIN_COLUMN), GRAIN_COLUMN
        if group is not None and group not in df.columns:
            raise ValueError(f"no column {group!r}")
        table = ov.overview(df, self.features, config)
        numbers, _ = split_kinds(df, self.features)
        if config.sparkline and numbers:
            drawn = ov.sparklines(df, numbers, config)
            table = table.join(F.broadcast(drawn), "feature", "left")
            rest = [c for c in table.columns if c not in ("feature", "dtype", "distribution")]
            table = table.select("feature", "dtype", "distribution", *rest).orderBy("dtype", "feature")
        report = Report(table)
        features = [f for f in self.features if f != group]
        numbers = [f for f in numbers if f != group]
        if group is None:
            return report
        key = F.col("`" + group.replace("`", "``") + "`")
        groups = [r["name"] for r in df.select(key.alias("g")).where("g is not null").distinct().select("g", F.col("g").cast("string").alias("name")).orderBy("g").collect()]
        metrics = (*config.dq_metrics, *(config.stat_metrics if numbers else ()))
        made = ov.trends(df, features, metrics, key, config) if metrics and features else {}
        for m in config.dq_metrics:
            if m in made:
                report.dq[m] = ov.pivoted(made[m], groups)
        for m in config.stat_metrics:
            if m in made:
                report.stats[m] = ov.pivoted(made[m], groups, with_stability=True)
        long = psi_ops.psi(df, features, key, config.psi_bins, config.psi_method, config.sentinels).withColumn("grp", F.col("grp").cast("string"))
        wide = ov.pivoted(long.withColumnRenamed("psi", "value"), sorted(groups))
        report.stats["psi"] = wide.join(psi_ops.psi_stability(long, config.psi_ignore), "feature", "left").orderBy("feature")
        return report
