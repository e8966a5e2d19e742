"""Streams: column functions and joins with fixed tables on unbounded input, and watermarked removal of repeated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nucleoframe.common import work_folder


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over one Parquet file or over all files of a folder, also those that come later."""
    # a pattern names a file as well as a folder; a plain path must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def with_columns(stream: DataFrame, columns: dict[str, Callable[[], object]]) -> DataFrame:
    """Column functions on a stream; no state is kept."""
    return stream.withColumns({k: f() for k, f in columns.items()})


def match_static(stream: DataFrame, fixed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A stream joined with a fixed table."""
    return stream.join(fixed, on, how)


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys weren't seen within ``delay``; older state is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Rows per window and key; late rows beyond ``delay`` are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def to_files(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there into Parquet files and read them; each row is written once, also after a restart."""
    spark = df.sparkSession
    folder = folder or work_folder(spark)
    df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there and keep the result as a table of this name (for tests)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
