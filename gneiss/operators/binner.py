"""Bins with the life of an estimator: set up, fitted, applied, in the table format that was asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from gneiss.errors import NotFitted
from gneiss.functions.values import Sentinels
from gneiss.operators.binning import Binning, fit, fit_optimal
from gneiss.session import timed
from gneiss.sources.frames import as_frame, formatted

OPTIMAL = "optimal"


class Binner:
    """Fits on Spark, pandas or Arrow tables and transforms others.

    ``method`` is quantile, uniform, cart or optimal.  Output is pandas for pandas tables and Spark for others, until :meth:`set_output`
    asks for one kind.
    """

    def __init__(self, method: str = "quantile", n_bins: int = 5, *, missing=(), special=(), features: list[str] | None = None, **options):
        self.method, self.n_bins, self.features, self.options = method, n_bins, features, options
        self.sentinels = Sentinels.of(missing, special)
        self.output: str | None = None
        self.binning: Binning | None = None

    @timed
    def fit(self, table, target: str | None = None) -> Binner:
        """Finds the bins and, with a target, their weights of evidence."""
        df = as_frame(None, table)
        if self.method == OPTIMAL:
            if target is None:
                raise ValueError("optimal bins need a target")
            self.binning = fit_optimal(df, target, self.features, n_bins=self.n_bins, sentinels=self.sentinels, **self.options)
        else:
            self.binning = fit(df, self.features, self.method, self.n_bins, target=target, sentinels=self.sentinels, **self.options)
        if target is not None:
            self.binning = self.binning.with_woes(df, target)
        return self

    @timed
    def transform(self, table, kind: str = "index"):
        """The table with columns of bin indexes, labels or weights of evidence."""
        return self._given(self._fitted().transform(as_frame(None, table), kind), table)

    def fit_transform(self, table, target: str | None = None, kind: str = "index"):
        return self.fit(table, target).transform(table, kind)

    def bin_stats(self, table, target: str):
        return self._given(self._fitted().bin_stats(as_frame(None, table), target), table)

    def feature_names_out(self, kind: str = "index") -> list[str]:
        return self._fitted().feature_names_out(kind)

    def set_output(self, kind: str | None) -> Binner:
        """From now on tables are given as "spark" or "pandas"; None follows the input again."""
        if kind not in (None, "spark", "pandas"):
            raise ValueError("output must be spark or pandas")
        self.output = kind
        return self

    def _fitted(self) -> Binning:
        if self.binning is None:
            raise NotFitted("fit the bins first")
        return self.binning

    def _given(self, out: DataFrame, table):
        return formatted(out, self.output or ("pandas" if isinstance(table, pd.DataFrame) else "spark"))
