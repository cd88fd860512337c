"""What the text operators share: cuts, batches bounded by bytes, and small Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.session import cut as session_cut
from stellate.session import fresh_path, remove_path, shared_root

__all__ = ["bounded_batches", "by_bytes", "cut", "fresh_path", "int_lists", "remove_path", "row_key", "settled", "shared_root", "tidy", "written"]

BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bounds the bytes of an Arrow batch by BATCH_BYTES, so that long texts don't pile up in the executor and its Python
    workers at once. For use before mapInArrow; a smaller bound of the session stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if now > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def settled(df: DataFrame, per_core: int = 8, merged: int = 4) -> DataFrame:
    """At most `per_core` tasks, and so files, for each core of the cluster, but never more than `merged` partitions of a
    shuffle in a task: small results of wide shuffles don't become thousands of tiny files, and tasks don't grow with
    the input. Not for rows that carry texts."""
    spark = df.sparkSession
    return df.coalesce(max(1, per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // merged))


@contextmanager
def tidy(spark: SparkSession):
    """Inside, the shuffle files of an action go when it ends, as its result lies in the shared folder. The setting of the
    session is as before afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    with tidy(df.sparkSession):
        return session_cut(settled(df))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of `df` from a new Parquet table in the shared folder, and its path."""
    path = fresh_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def row_key(id_col: str, text_col: str) -> Column:
    """Equal rows share it; two rows that share an id but not a text don't."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut each batch so that a piece holds about `limit` bytes of `column`, or one row."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        held = 0
        for i, size in enumerate(sizes):
            if i > at and held + size > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        yield batch.slice(at, n - at)


def int_lists(chunks: list[bytes]) -> pa.ListArray:
    """list<int32> from the little-endian bytes of each row."""
    import numpy as np

    ends = np.cumsum([0, *(len(c) // 4 for c in chunks)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(chunks))]))
