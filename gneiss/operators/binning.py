"""Bins of numeric and categorical features: fitting, index / label / WOE columns and risk tables.

Indexes: -1 missing (null, NaN, custom), -2 a category that no rule has, -3 - i the i-th special value of the column's type,
0.. normal bins, closed on the left.  A fitted binning is a small driver-side object; transforms are one projection.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.errors import NotFitted
from gneiss.functions.values import Sentinels, among, cleaned, is_numeric
from gneiss.operators import splits
from gneiss.plans.longform import frequencies, melt, order_statistics
from gneiss.plans.store import stored

MISSING, OTHER, SPECIAL = -1, -2, -3
EPS = 1e-6
INF = math.inf


def _edges(cuts) -> list[float]:
    return [-INF, *sorted({float(c) for c in cuts if c is not None and math.isfinite(c)}), INF]


def _label(i: int, low: float, high: float) -> str:
    return f"{i:02d}_[{low:.3g}, {high:.3g})"


def _find(c: Column, inner: list[float], low: int, high: int) -> Column:
    """A balanced tree of comparisons: the number of cuts at or below ``c``."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(c < F.lit(inner[mid]), _find(c, inner, low, mid)).otherwise(_find(c, inner, mid + 1, high))


@dataclass
class Binning:
    """Cuts of numeric features and groups of categories.

    ``cuts`` maps a feature to edges from -inf to inf; an empty list means that nothing but missing values was seen.
    ``groups`` maps a feature to lists of categories.  ``woes`` maps a feature to {index: weight of evidence}.
    Features with more than ``join_above`` categories are looked up by a join, others by an expression.
    """

    cuts: dict[str, list[float]] = field(default_factory=dict)
    groups: dict[str, list[list[str]]] = field(default_factory=dict)
    sentinels: Sentinels = Sentinels()
    woes: dict[str, dict[int, float]] = field(default_factory=dict)
    join_above: int = 100

    @property
    def features(self) -> list[str]:
        return [*self.cuts, *[g for g in self.groups if g not in self.cuts]]

    def feature_names_out(self, kind: str = "index") -> list[str]:
        return [f"{f}_{'woe' if kind == 'woe' else 'bin'}" for f in self.features]

    def to_json(self) -> str:
        return json.dumps({"cuts": {k: [str(x) for x in v] for k, v in self.cuts.items()}, "groups": self.groups, "missing": list(self.sentinels.missing), "special": list(self.sentinels.special), "woes": {k: list(v.items()) for k, v in self.woes.items()}, "join_above": self.join_above})

    @staticmethod
    def from_json(text: str) -> Binning:
        d = json.loads(text)
        return Binning({k: [float(x) for x in v] for k, v in d["cuts"].items()}, d["groups"], Sentinels.of(d["missing"], d["special"]), {k: {int(a): b for a, b in v} for k, v in d["woes"].items()}, d["join_above"])

    def labels(self, feature: str) -> dict[int, str]:
        """The label of each index of a feature."""
        numeric = feature in self.cuts
        out = {MISSING: "Missing", OTHER: "Other"}
        out |= {SPECIAL - i: f"Special_{_plain(v)}" for i, v in enumerate(self.sentinels.typed("special", numeric, not numeric))}
        if numeric:
            e = self.cuts[feature]
            out |= {i: _label(i, e[i], e[i + 1]) for i in range(len(e) - 1)} if len(e) > 2 else {0: "00_[-inf, inf)"}
        else:
            out |= {i: f"{i:02d}_[{','.join(g[:3])}{',...' if len(g) > 3 else ''}]" for i, g in enumerate(self.groups[feature])}
        return out

    def index(self, df: DataFrame, feature: str, found: Column | None = None) -> Column:
        """The bin index; ``found`` is the group number where a join has looked it up."""
        c = F.col(f"`{feature}`")
        s = self.sentinels
        if feature in self.cuts:
            gone = c.isNull() | among(c, s.numbers("missing"))
            if is_numeric(df.schema[feature].dataType):
                gone = gone | F.isnan(c.cast("double"))
            out = F.when(gone, MISSING)
            for i, v in enumerate(s.numbers("special")):
                out = out.when(c == v, SPECIAL - i)
            inner = [x for x in self.cuts[feature] if math.isfinite(x)]
            return out.otherwise(_find(c.cast("double"), inner, 0, len(inner))).cast("short")
        text = c.cast("string")
        out = F.when(text.isNull() | among(text, s.strings("missing", True)), MISSING)
        if found is not None:
            out = out.when(found.isNotNull(), found)
        else:
            for i, group in enumerate(self.groups[feature]):
                out = out.when(text.isin(group), i)
        for i, v in enumerate(s.strings("special", True)):
            out = out.when(text == v, SPECIAL - i)
        return out.otherwise(OTHER).cast("short")

    def transform(self, df: DataFrame, kind: str = "index", features: list[str] | None = None) -> DataFrame:
        """``df`` with ``{feature}_bin`` (index or label) or ``{feature}_woe``; a bin without a WOE has 0."""
        if not self.features:
            raise NotFitted("fit a binning, or make one from rules")
        if kind not in ("index", "label", "woe"):
            raise ValueError("kind must be index, label or woe")
        made, extra = {}, []
        for f in features or self.features:
            if f not in df.columns:
                continue
            found = None
            if f in self.groups and f not in self.cuts and sum(map(len, self.groups[f])) > self.join_above:
                rows = [(v, i) for i, g in enumerate(self.groups[f]) for v in g]
                n = len(extra)
                table = df.sparkSession.createDataFrame(rows, f"_k{n} string, _i{n} int").dropDuplicates([f"_k{n}"])
                df = df.join(table, F.col(f"`{f}`").cast("string") == F.col(f"_k{n}"), "left")
                found = F.col(f"_i{n}")
                extra += [f"_k{n}", f"_i{n}"]
            i = self.index(df, f, found)
            if kind == "index":
                made[f"{f}_bin"] = i
            else:
                values = self.labels(f) if kind == "label" else self.woes.get(f, {})
                pairs = [x for k, v in values.items() for x in (F.lit(k).cast("short"), F.lit(v))]
                known = F.try_element_at(F.create_map(*pairs), i) if pairs else F.lit(None)
                made[f"{f}_bin" if kind == "label" else f"{f}_woe"] = F.coalesce(known, i.cast("string") if kind == "label" else F.lit(0.0))
        return df.withColumns(made).drop(*extra)

    def long_counts(self, df: DataFrame, target: Column | None = None, keys: dict[str, Column] | None = None) -> DataFrame:
        """``feature``, ``bin``, ``n`` and, with a target, ``bad``: one aggregate over all features."""
        some = [f for f in self.features if f in df.columns]
        keys = dict(keys or {})
        if target is not None:
            keys["y"] = target.cast("double")
        wide = self.transform(df.select("*", *[c.alias(f"_key_{k}") for k, c in keys.items()]), features=some)
        wide = wide.select(*[F.col(f"_key_{k}").alias(k) for k in keys], *[F.col(f"`{f}_bin`").alias(f) for f in some])
        long = wide.unpivot([*keys], [f"`{f}`" for f in some], "feature", "bin")
        by = [k for k in keys if k != "y"]
        sums = [F.count(F.lit(1)).alias("n")] + ([F.sum("y").alias("bad")] if target is not None else [])
        return long.groupBy(*by, "feature", "bin").agg(*sums)

    def bin_stats(self, df: DataFrame, target: str) -> DataFrame:
        """Risk table by feature and bin; distributions add up in the order of the indexes, negative ones first."""
        t = self.long_counts(df, F.col(target)).withColumns({"count": F.col("n"), "good": F.col("n") - F.col("bad")})
        w = Window.partitionBy("feature")
        total = t.withColumns({"rows": F.sum("n").over(w), "bads": F.sum("bad").over(w)}).withColumn("goods", F.col("rows") - F.col("bads"))
        t = total.withColumns({"count_dist": F.col("n") / F.col("rows"), "bad_rate": F.col("bad") / F.col("n"), "bad_dist": F.col("bad") / (F.col("bads") + EPS), "good_dist": F.col("good") / (F.col("goods") + EPS)})
        t = t.withColumn("woe", F.log((F.col("bad_dist") + EPS) / (F.col("good_dist") + EPS)))
        t = t.withColumns({"bin_iv": (F.col("bad_dist") - F.col("good_dist")) * F.col("woe"), "lift": F.col("bad_rate") / (F.col("bads") / F.col("rows") + EPS)})
        run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumns({"cum_bad_dist": F.sum("bad_dist").over(run), "cum_good_dist": F.sum("good_dist").over(run), "total_iv": F.sum("bin_iv").over(w)})
        t = t.withColumn("bin_ks", F.abs(F.col("cum_bad_dist") - F.col("cum_good_dist")))
        pairs = [(f, i, name) for f in self.features for i, name in self.labels(f).items()]
        names = F.broadcast(df.sparkSession.createDataFrame(pairs, "feature string, bin short, bin_label string"))
        t = t.join(names, ["feature", "bin"], "left")
        order = ["count", "bad", "good", "count_dist", "bad_rate", "bad_dist", "good_dist", "woe", "bin_iv", "lift", "cum_bad_dist", "cum_good_dist", "bin_ks", "bin_label", "total_iv"]
        return t.select(F.concat("feature", F.lit("_bin")).alias("feature"), F.col("bin").alias("bin_index"), *order).orderBy("feature", "bin_index")

    def woe_table(self, df: DataFrame, target: str) -> DataFrame:
        """``feature``, ``bin``, ``woe`` = ln(((b + e) / (B + e)) / ((g + e) / (G + e)))."""
        t = self.long_counts(df, F.col(target)).withColumn("good", F.col("n") - F.col("bad"))
        w = Window.partitionBy("feature")
        t = t.withColumns({"bads": F.sum("bad").over(w), "goods": F.sum("good").over(w)})
        return t.select("feature", "bin", F.log(((F.col("bad") + EPS) / (F.col("bads") + EPS)) / ((F.col("good") + EPS) / (F.col("goods") + EPS))).alias("woe"))

    def with_woes(self, df: DataFrame, target: str) -> Binning:
        """The same binning with the weights of evidence of ``df``."""
        woes: dict[str, dict[int, float]] = {}
        for r in self.woe_table(df, target).collect():
            woes.setdefault(r["feature"], {})[r["bin"]] = r["woe"]
        return Binning(self.cuts, self.groups, self.sentinels, woes, self.join_above)


def _plain(v) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def from_rules(cuts: dict | None = None, groups: dict | None = None, **more) -> Binning:
    return Binning({f: _edges(c) for f, c in (cuts or {}).items()}, {f: [[str(v) for v in g] for g in gs] for f, gs in (groups or {}).items()}, **more)


def _ranges(values: DataFrame) -> dict[str, tuple]:
    """Raw smallest and largest value of each feature."""
    return {r["feature"]: (r["lo"], r["hi"]) for r in values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}


def fit(df: DataFrame, features: list[str] | None = None, method: str = "quantile", n_bins: int = 5, *, target: str | None = None, sentinels: Sentinels = Sentinels(), min_share: float = 0.05, drop_empty: bool = False, join_above: int = 100) -> Binning:
    """A binning of the numeric features by quantiles, equal widths ("uniform") or a decision tree ("cart")."""
    if method not in ("quantile", "uniform", "cart"):
        raise ValueError("method must be quantile, uniform or cart")
    if method == "cart" and target is None:
        raise ValueError("cart needs a target")
    names = [f for f in (features or df.columns) if f in df.columns and f != target and is_numeric(df.schema[f].dataType)]
    nothing = [f for f in (features or df.columns) if f in df.columns and f != target and df.schema[f].dataType.typeName() == "void"]
    # One table of raw values and their numbers serves all that follows; a tree's also has the target.
    real = "value is not null and not isnan(value)"
    if method == "cart":
        long = melt(df, names, {"y": F.col(target).cast("double")}).where(real) if names else None
        sums = (F.count("y").alias("n"), F.sum("y").alias("bad"))
        values = stored(long.groupBy("feature", "value").agg(*sums)) if names else None
    else:
        values = stored(frequencies(melt(df, names).where(real), ["feature"])) if names else None
    ranges = _ranges(values) if names else {}
    cuts: dict[str, list[float]] = {f: [] for f in nothing}
    rest = []
    for f in names:
        if f not in ranges:
            cuts[f] = []
        elif ranges[f][0] == ranges[f][1]:
            cuts[f] = [-INF, INF]
        else:
            rest.append(f)
    if rest:
        excluded = sentinels.numbers("missing") + sentinels.numbers("special")
        freq = values.where(F.col("feature").isin(rest)).withColumn("value", cleaned(F.col("value"), excluded)).where("value is not null")
        if method == "cart":
            found = splits.cuts_of_counts(freq.where("n > 0"), n_bins, min_share)
        else:
            found = _quantile_cuts(freq, n_bins) if method == "quantile" else _uniform_cuts(freq, n_bins, drop_empty)
        cuts |= {f: _edges(found.get(f, [])) for f in rest}
    return Binning({f: cuts[f] for f in [*names, *nothing]}, {}, sentinels, {}, join_above)


def _quantile_cuts(freq: DataFrame, n_bins: int) -> dict[str, list[float]]:
    q = [i / n_bins for i in range(1, n_bins)] if n_bins > 1 else [0.5]
    out: dict[str, list[float]] = {}
    for r in order_statistics(freq, ["feature"], q).collect():
        out.setdefault(r["feature"], []).append(r["value"])
    return out


def _uniform_cuts(freq: DataFrame, n_bins: int, drop_empty: bool) -> dict[str, list[float]]:
    """Midpoints between the values where they are few, else equally spaced points."""
    sizes = freq.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    few = [r["feature"] for r in sizes if r["distinct"] <= n_bins]
    out = {r["feature"]: [r["lo"] + (r["hi"] - r["lo"]) * i / n_bins for i in range(1, n_bins)] for r in sizes if r["feature"] not in few}
    if few:
        for r in freq.where(F.col("feature").isin(few)).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("v")).collect():
            out[r["feature"]] = [(a + b) / 2 for a, b in zip(r["v"][:-1], r["v"][1:], strict=True)]
    wide = [f for f in out if f not in few]
    if drop_empty and wide:
        table = F.broadcast(freq.sparkSession.createDataFrame([(f, out[f]) for f in wide], "feature string, cuts array<double>"))
        place = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
        held: dict[str, set[int]] = {}
        for r in freq.join(table, "feature").select("feature", place.alias("i")).distinct().collect():
            held.setdefault(r["feature"], set()).add(r["i"])
        out |= {f: [c for i, c in enumerate(out[f]) if i in held.get(f, ())] for f in wide}
    return out


def fit_optimal(df: DataFrame, target: str, features: list[str] | None = None, cat_features: list[str] | None = None, n_bins: int = 5, *, n_prebins: int = 50, prebinning: str = "quantile", trend: str = "auto_asc_desc", sentinels: Sentinels = Sentinels(), min_bin_share: float = 0.05, max_categories: int = 100, rare_share: float = 0.05, join_above: int = 1000) -> Binning:
    """Bins that merge prebins so that the information value is largest under a bad rate that rises or falls throughout."""
    named = [f for f in (features or df.columns) if f != target and f in df.columns]
    cats = [f for f in (cat_features if cat_features is not None else [f for f in named if not is_numeric(df.schema[f].dataType)]) if f in df.columns]
    numbers = [f for f in named if f not in cats and is_numeric(df.schema[f].dataType)]
    pre = fit(df, numbers, prebinning, n_prebins, target=target, sentinels=sentinels, min_share=1 / n_prebins) if numbers else Binning({}, {}, sentinels)
    counts: dict[str, dict[int, tuple]] = {}
    if numbers:
        for r in pre.long_counts(df.where(F.col(target).isNotNull()), F.col(target)).where("bin >= 0").collect():
            counts.setdefault(r["feature"], {})[r["bin"]] = (r["n"], r["bad"])
    cuts = {f: splits.merge_cuts(e, counts.get(f, {}), n_bins, min_bin_share, trend) for f, e in pre.cuts.items()}
    groups = {f: splits.category_groups(_category_counts(df, f, target, sentinels, max_categories), n_bins, rare_share, min_bin_share) for f in cats}
    return Binning(cuts, {f: g for f, g in groups.items() if g}, sentinels, {}, join_above)


def _category_counts(df: DataFrame, feature: str, target: str, sentinels: Sentinels, most: int) -> list[tuple]:
    """(category, rows, bads) of the ``most`` commonest categories, ties by name; the rest is "Other_Pre"."""
    text = F.col(f"`{feature}`").cast("string")
    rows = df.select(text.alias("v"), F.col(target).cast("double").alias("y")).where(F.col("v").isNotNull() & F.col("y").isNotNull() & ~among(F.col("v"), sentinels.strings("missing", True)))
    table = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))
    top = table.orderBy(F.desc("n"), "v").limit(most).collect()
    whole = table.agg(F.sum("n"), F.sum("bad"), F.count(F.lit(1))).first()
    out = [(r["v"], r["n"], r["bad"]) for r in top]
    if whole[2] > len(out):
        out.append(("Other_Pre", whole[0] - sum(x[1] for x in out), whole[1] - sum(x[2] for x in out)))
    return out
