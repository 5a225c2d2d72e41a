"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text in one Arrow batch. Texts may be long, so batches are small.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. The session's Arrow batches are lowered to BATCH_ROWS if they are larger:
    they bound the memory of Python workers, and only the session can say so."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it. Only a session in one process, as in
    tests, gets a folder of its own where none is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: What cut has written: by open scratch blocks, and outside of them until the process ends.
_written: list[list[str]] = [[]]


def remove(path: str) -> None:
    """Delete a folder through Spark's file systems; without a JVM there is nothing that could."""
    jvm = SparkContext._jvm
    if jvm is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        held = SparkContext._active_spark_context
        settings = held._jsc.hadoopConfiguration() if held and held._jsc else jvm.org.apache.hadoop.conf.Configuration()
        place.getFileSystem(settings).delete(place, True)


@contextmanager
def scratch() -> Iterator[None]:
    """What cut writes in this block is deleted when the block ends: its results must have been written by then."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            remove(path)


@atexit.register
def _at_exit() -> None:
    while _written[0]:
        try:
            remove(_written[0].pop())
        except Exception:  # the JVM has gone
            return


def cut(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it again: lineage ends here, executors may go. The folder is deleted
    at the end of the innermost scratch block, or of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _written[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined with a table that has one row for each key and counts its rows. Keys that hold more
    than one of ``share`` rows, so fewer than ``share`` keys, are broadcast; the others are shuffled, and
    none of them is hot."""
    heavy = table.where(F.col(count) * share > total).select(F.xxhash64(*keys)).collect()
    if not heavy:
        return rows.join(table, keys)
    hot = F.xxhash64(*keys).isin([r[0] for r in heavy])
    return rows.where(hot).join(F.broadcast(table.where(hot)), keys).unionByName(rows.where(~hot).join(table.where(~hot), keys))


def hot_keys(df: DataFrame, keys: list[str], share: int = 1000, least: int = 1000) -> list[int]:
    """Hashes of the keys that hold more than one of ``share`` rows (so fewer than ``share`` keys), and more than ``least``."""
    total = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return [r[0] for r in counts.where((F.col("_c") * share > total) & (F.col("_c") > least)).select(F.xxhash64(*keys)).collect()]


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, hot: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """left joined with right (tables that are cheap to read again, unless the ``hot`` keys of both are given). The rows of a key that is hot on one side are
    dealt, by a hash of the row, to ``salts`` parts, and those of the other side go to each of them; a key that
    is hot on both sides is dealt to a square of parts. All other keys are joined as they are."""
    hot_left, hot_right = hot or (hot_keys(left, keys), hot_keys(right, keys))
    if not hot_left and not hot_right:
        return left.join(right, keys)
    parts = lambda hot: F.when(F.xxhash64(*keys).isin(hot), salts).otherwise(1) if hot else F.lit(1)
    mine = lambda df, hot: F.pmod(F.xxhash64(*df.columns), parts(hot)).cast("int")
    every = lambda hot: F.explode(F.sequence(F.lit(0), parts(hot) - 1))
    a = left.select("*", mine(left, hot_left).alias("_i"), every(hot_right).alias("_j"))
    b = right.select("*", every(hot_left).alias("_i"), mine(right, hot_right).alias("_j"))
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text, modulo modulus; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def crc32_of(value: object) -> int:
    return zlib.crc32(str(value).encode())


def arrow_map(df: DataFrame, schema: T.StructType, rows: Callable[[], Callable[[list[list]], list[list]]], passed: int = 0) -> DataFrame:
    """mapInArrow over column lists.

    ``rows()`` is called once for each task and returns a function from the
    input columns (lists) to the output columns (lists). The first ``passed``
    columns are not turned into lists: they come out first, as they are (and
    the function keeps the number of rows). Batches are cut to BATCH_ROWS,
    whatever the session's setting is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                kept = [c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns[:passed], arrow)]
                made = step([c.to_pylist() for c in batch.columns[passed:]])
                kept += [pa.array(c, arrow.field(passed + n).type) for n, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays(kept, schema=arrow)

    return df.mapInArrow(run, schema)


def struct_of(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]
