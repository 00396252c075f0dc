"""What several operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import durable, tune

__all__ = ["durable", "settle", "table", "bounded_copy", "bit_filter", "has_bit", "same", "texts", "record_batch"]


#: Rows and bytes of an Arrow batch: texts can be long, and a worker holds a batch more than once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def settle(spark: SparkSession) -> SparkSession:
    """The runtime settings the plans count on."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return settle(spark).read.parquet(f"{folder}/{name}.parquet")


def bounded_copy(df: DataFrame, rows: int) -> list:
    """The rows of a result that cannot have more than ``rows`` rows; anything else is an error."""
    found = df.take(rows + 1)
    if len(found) > rows:
        raise ValueError(f"expected at most {rows} rows on the driver")
    return found


def bit_filter(rows: DataFrame, column: str, bits: int) -> bytes:
    """A set bit for the remainder of every value of a long column: never more than ``bits`` bits on the driver.

    Who tests a bit may take a value for one of the rows that is none, never the other way round.
    """
    slot = F.pmod(F.col(column), F.lit(bits)) + 1
    slots = rows.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("place"))
    # Values are dealt out before they become bitmaps, else every map task would send nearly all bitmaps.
    words = slots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    out = bytearray(bits // 8)
    for row in bounded_copy(words, bits // 32768):
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = row["bitmap"]
    return bytes(out)


def has_bit(table: bytes, values: np.ndarray, bits: int) -> np.ndarray:
    slots = np.mod(values, bits)
    return (np.frombuffer(table, np.uint8)[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on ``keys`` under which NULL equals NULL."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, NULL as empty."""
    values = batch.column(column)
    for value in values.cast(pa.binary() if values.type == pa.string() else pa.large_binary()):
        yield value.as_py() or b""


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
