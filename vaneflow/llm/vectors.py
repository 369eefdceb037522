"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Whole components beyond this count as this, so that sums of squares stay in 64 bits.
LIMIT = 1 << 24


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.float64)  # null as NaN
        odd = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isfinite(flat), len(size)) > 0
        whole = np.clip(np.floor(SCALE * flat[~np.repeat(odd, size)]), -LIMIT, LIMIT).astype("<i4")
        ends = np.concatenate([[0], np.cumsum(size[~odd])]) * 4
        made = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(whole)])
        batch = batch.filter(pa.array(~odd))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["vec_id", "label", "x"])


def whole_vectors(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(vec_id, label, x) of every row whose vector is neither null nor holds a null or non-finite component.

    x: floor(SCALE * component), as little-endian integers of 4 bytes; beyond LIMIT they count as LIMIT.
    """
    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return rows.mapInArrow(_whole, f"vec_id {kinds[0]}, label {kinds[1]}, x binary")


def matrix(x: pa.Array | list[bytes]) -> np.ndarray:
    """The vectors, all of one length, as rows."""
    rows = x.to_pylist() if isinstance(x, pa.Array) else x
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Of a written table of whole vectors those as long as that of the least vec_id (nulls last), and that length."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.octet_length("x")).first()
    size = first[0] if first else 0
    return rows.filter(F.octet_length("x") == size), size // 4
