"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text handled at once inside a task; numpy temporaries are a small multiple of it.
SLICE_BYTES = 1 << 19
SLICE_ROWS = 2048
#: Rows of a narrow table (150 bytes each at most) up to this number are broadcast; more are joined by salted key.
BROADCAST_ROWS = 200_000
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A new folder for a Parquet table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def looked_up(rows: DataFrame, narrow: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with the written table ``narrow``; a key that very many of ``rows`` have is never one task's.

    ``narrow`` is broadcast if it counts BROADCAST_ROWS at most.  Else each of its rows is there once a salt, and
    ``salt`` (a hash of what tells the rows of a key apart) deals a key's rows to ``SALTS`` parts.
    """
    if narrow.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(narrow), on, how)
    every = narrow.withColumn("llm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(salt, F.lit(SALTS)).cast("int")
    return rows.withColumn("llm_salt", part).join(every, [*on, "llm_salt"], how).drop("llm_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], text: str,
                max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices with at most ``max_rows`` rows and ``max_bytes`` of text,
    or a single longer text.

    ``bytes[offsets[i]:offsets[i + 1]]`` is row i's text as UTF-8; a null text has no bytes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        offsets, data = string_buffers(column)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
            last = min(max(last, first + 1), first + max_rows, len(column))
            part = offsets[first:last + 1]
            yield batch.slice(first, last - first), data[part[0]:part[-1]], part - part[0]
            first = last


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    chars = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets.astype(np.int64), chars
