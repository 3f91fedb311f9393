"""What the operators of this subpackage share: row keys, stored tables, Arrow access, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.graphs import components  # noqa: F401
from lamella.storage import discard, release, shared_folder  # noqa: F401

LONG_MIN = -(1 << 63)
CHUNK_BYTES = 1 << 20


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns (key_id, key_h, row_id, text) of ``docs``; nothing else is carried.

    A null text counts as empty. (key_id, key_h) identifies a row even where ids
    are null or repeat: key_h has 64 bits of the text; rows equal in both columns share it and share every result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*keyed_columns(id_col, text_col), F.col(id_col).cast("long").alias("row_id"), text.alias("text"))


def keyed_columns(id_col: str, text_col: str) -> list[Column]:
    text, row = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return [F.coalesce(row, F.lit(LONG_MIN)).alias("key_id"), F.xxhash64(text, row.isNull()).alias("key_h")]


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamella/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamella_path = path
    release(spark)
    return out


def filtered(docs: DataFrame, text_col: str, keep: Callable) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which ``keep`` holds: it maps a text column without nulls to a mask."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(decide(pc.fill_null(b.column(place), ""))))

    return docs.mapInArrow(run, docs.schema)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column, and the offset of each value (no copy)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of about ``size`` bytes and at most ``rows`` values; a longer value is alone."""
    data, offsets = buffer(column)
    row = 0
    while row < len(offsets) - 1:
        stop = min(row + rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def crc32(column: Column) -> Column:
    return F.crc32(column.cast("string"))


#: A key of more rows than EACH is dealt over several tasks; so many keys are known to every task (some 40 bytes each).
EACH, MOST = 4096, 10_000


def spread_join(rows: DataFrame, counted: DataFrame, on: list[str], count: str, by: list[str], each: int = EACH) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row for each key in ``on`` and in ``count`` how many ``rows`` there are of it.

    The rows of a frequent key are dealt by a hash of the columns ``by`` over tasks of some ``each`` rows; the other
    side is repeated for each. A broadcast names the MOST most frequent keys, so any other key has less than 1 / MOST of all rows.
    """
    often = counted.where(F.col(count) > each).orderBy(F.desc(count), *on).limit(MOST)
    often = F.broadcast(often.select(*on, F.ceil(F.col(count) / each).cast("int").alias("__deals")))
    deal = F.when(F.col("__deals").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__deals")).cast("int"))
    left = rows.join(often, on, "left").withColumn("__deal", deal).drop("__deals")
    every = F.when(F.col("__deals").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__deals") - 1))
    right = counted.join(often, on, "left").withColumn("__deal", F.explode(every)).drop("__deals", count)
    return left.join(right, [*on, "__deal"]).drop("__deal")
