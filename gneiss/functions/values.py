"""Roles of values: nulls, custom missing values, special values and normal ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def is_numeric(kind: T.DataType) -> bool:
    """Whole and floating numbers; decimals, booleans and dates count as categories."""
    return isinstance(kind, NUMERIC)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


@dataclass(frozen=True)
class Sentinels:
    """Values that stand for something else; a column sees only those of its type."""

    missing: tuple = ()
    special: tuple = ()

    @staticmethod
    def of(missing: Iterable = (), special: Iterable = ()) -> Sentinels:
        return Sentinels(tuple(missing or ()), tuple(special or ()))

    def numbers(self, which: str) -> list[float]:
        return [float(v) for v in getattr(self, which) if _number(v)]

    def strings(self, which: str, every: bool = False) -> list[str]:
        """Only strings, or every value as text."""
        return [str(v) for v in getattr(self, which) if v is not None and (every or isinstance(v, str))]

    def typed(self, which: str, numeric: bool, every: bool = False) -> list:
        return self.numbers(which) if numeric else self.strings(which, every)


def among(c: Column, values: list) -> Column:
    """Whether a value is one of a list; false for null."""
    return F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)


def cleaned(c: Column, excluded: list) -> Column:
    return F.when(~among(c, excluded), c) if excluded else c


def pick_features(df: DataFrame, features=None, exclude=None, kinds=None) -> list[str]:
    """Features asked for (or all columns) that are neither excluded nor of other kinds.

    ``kinds`` holds Python types or names of Spark types.
    """
    families = {int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), float: (T.FloatType, T.DoubleType), str: (T.StringType,), bool: (T.BooleanType,), list: (T.ArrayType,)}
    named = [f for f in (features or df.columns) if f in df.columns and f not in set(exclude or ())]
    if kinds is not None:
        kinds = kinds if isinstance(kinds, (list, tuple, set)) else [kinds]
        fits = lambda k: any(isinstance(k, families[x]) if x in families else k.simpleString() == str(x) for x in kinds)
        named = [f for f in named if fits(df.schema[f].dataType)]
    if not named:
        raise ValueError("no features are left")
    return named
