"""Tables from Spark, pandas and Arrow, with checks at the border, samples, and output formats."""

from __future__ import annotations

import warnings

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.errors import BadType
from gneiss.functions.values import is_numeric


def as_frame(spark: SparkSession | None, table) -> DataFrame:
    """A Spark table from a Spark, pandas or Arrow one; anything else is refused.  Without a session the running one is taken."""
    if isinstance(table, DataFrame):
        return table
    spark = spark or SparkSession.builder.getOrCreate()
    if isinstance(table, pa.Table):
        return spark.createDataFrame(table)
    if isinstance(table, pd.DataFrame):
        out = spark.createDataFrame(table)
        check_conversion(table, out)
        return out
    raise BadType(f"expected a table, not {type(table).__name__}")


def check_conversion(source: pd.DataFrame, out: DataFrame) -> None:
    """Raises where numbers became something else; warns where text columns look like numbers."""
    for name in source.columns:
        kind = out.schema[name].dataType
        if pd.api.types.is_numeric_dtype(source[name]) and not pd.api.types.is_bool_dtype(source[name]) and not is_numeric(kind) and not source[name].isna().all():
            raise BadType(f"{name} was numeric and became {kind.simpleString()}")
    if dirty := number_like(out):
        warnings.warn(f"text columns that look like numbers: {', '.join(dirty)}", UserWarning, stacklevel=3)


def number_like(df: DataFrame, rows: int = 10) -> list[str]:
    """Text columns whose first values all read as numbers."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "string":
            head = df.select(F.col(f"`{f.name}`").alias("v")).where("v is not null").limit(rows).select(F.col("v").try_cast("double").isNotNull().alias("ok")).collect()
            if head and all(r["ok"] for r in head):
                out.append(f.name)
    return out


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A file or folder by Spark's readers."""
    return spark.read.format(kind).options(**options).load(path)


def sample_share(df: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """About that share of the rows."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    return df.sample(fraction=share, seed=seed)


def sample_rows(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Exactly n rows without replacement, or all if there are fewer."""
    return df.orderBy(F.rand(seed)).limit(n)


def formatted(data, kind: str = "spark"):
    """Tables as they are or as pandas, in lists and dicts too."""
    if kind not in ("spark", "pandas"):
        raise ValueError("kind must be spark or pandas")
    if isinstance(data, dict):
        return {k: formatted(v, kind) for k, v in data.items()}
    if isinstance(data, (list, tuple)):
        return type(data)(formatted(v, kind) for v in data)
    return data.toPandas() if kind == "pandas" and isinstance(data, DataFrame) else data
