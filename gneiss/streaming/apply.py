"""Fitted binnings on streams: their transforms hold no state, so they apply to a stream as they do to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators.binning import Binning


def binned_stream(stream: DataFrame, binning: Binning, kind: str = "index") -> DataFrame:
    return binning.transform(stream, kind)


def counts_by_window(stream: DataFrame, binning: Binning, feature: str, time_column: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows of each bin in each time window; what comes later than ``late`` is left out."""
    made = binning.transform(stream, features=[feature]).withWatermark(time_column, late)
    return made.groupBy(F.window(time_column, window), F.col(f"{feature}_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet files, each input row once; ends when all input present at the start has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
