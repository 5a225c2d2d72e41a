"""Blocks that arrive as a stream of Parquet files: positions filled in, repeated deliveries dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridloom.functions.geometry import Geometry
from gridloom.operators.model import coerce_positions, derived_block_id, ordered, without_nan


def read_blocks(spark: SparkSession, path: str, schema: StructType, geometry: Geometry, time: str | None = None, lateness: str = "1 hour", files_per_trigger: int = 100) -> DataFrame:
    """The canonical rows of each file as it comes. With a time column, a block that is delivered again
    within the lateness is dropped; without one, state would have to be kept for ever and nothing is."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    rows = without_nan(rows)
    rows = geometry.with_positions(rows.withColumn("block_id", derived_block_id(rows, geometry)))
    if time:
        rows = rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["block_id"])
    return coerce_positions(rows).select(*ordered(rows.columns))


def write_blocks(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_volume(rows: DataFrame, geometry: Geometry, time: str, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Blocks and their volume by window of time, late rows up to the lateness."""
    return rows.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("blocks"), (F.count(F.lit(1)) * geometry.volume).alias("volume"))
