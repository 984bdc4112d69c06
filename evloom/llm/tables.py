"""What the operators of this package share: reading tables and naming documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and the size is known to the planner.

    A lost executor replays files, and a small result may be broadcast because its size in bytes is
    measured, not assumed.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches of this session by bytes too: a number of rows says nothing about the memory of long texts.

    A smaller bound that the session already has stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > _BATCH:
        spark.conf.set(name, str(_BATCH))


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes, of one row at least."""
    row = max(1, batch.nbytes // max(1, len(batch)))
    step = max(1, limit // row)
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        # rows differ in size: what is still too large is halved
        if len(part) > 1 and part.nbytes > 2 * limit:
            middle = len(part) // 2
            yield from slices(part.slice(0, middle), limit)
            yield from slices(part.slice(middle), limit)
        else:
            yield part


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document key and text only, under names that no user column has.

    Rows that share id and text are one document: they share every decision.
    """
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
