"""Token ids as Parquet list columns, in id order, for selective reads.

Layout of a folder that `write_tokens` makes: one file for each range of ids, in order of `part`. Columns: the id, part,
local_start (ids of the documents before it in its part), n_tokens, token_ids (list of int). token_ids are
dictionary-encoded (ids of a vocabulary of 50,000 take 16 bits or fewer), id and local_start delta-encoded; row groups
and pages are small and the footers carry page indexes, so that a filter on the id reads the pages it needs and a
reader of metadata columns never touches the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes
from stellate.llm.tokens import encoder, tokenizer_path

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
BEGINNING = 32  # characters of a text by which rows of one id are dealt


def write_tokens(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, path: str | None = None) -> str:
    """Encode every whole text and write the ids, in ascending id order, to the folder `out`.

    A null text is empty: only `end_id`, which closes each document. Rows that share an id are ordered by their text, by whose
    beginnings many of them are dealt over tasks; a null id comes first. Texts of any length are encoded whole; an empty table
    gives a folder without rows. Extra columns are not read.
    """
    path = path or tokenizer_path(tokenizer)

    def run(batches):
        enc, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for b in by_bytes(batches, "text"):
            ids, at = enc.arrays(b.column(1))
            if end_id is not None:
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            n = np.diff(at)
            starts = start + at[:-1]
            start += int(at[-1])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists], ["id", "part", "local_start", "n_tokens", "token_ids"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    coded = src.repartitionByRange(F.col("id"), F.substring("text", 1, BEGINNING)).sortWithinPartitions("id", "text").transform(bounded_batches).mapInArrow(run, f"id {kind}, part int, local_start long, n_tokens long, token_ids array<int>")
    (
        coded.withColumnRenamed("id", id_col)
        .write.option("compression", "snappy")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", "20000")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option(f"parquet.enable.dictionary#{id_col}", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .parquet(out)
    )
    return out


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table as written; name columns to read no others. Filters on the id reach the page indexes."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_starts(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds start to rows made from `table`: the number of ids of all documents before. Gathers one row for each part,
    from the metadata columns."""
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def with_crc(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the ids of each row back: id, part, local_start, n_tokens (their count) and ids_crc32 over them."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["id", "part", "local_start", "n_tokens", "ids_crc32"])

    kind = table.schema[id_col].dataType.simpleString()
    src = table.select(F.col(id_col).alias("id"), "part", "local_start", "token_ids")
    return bounded_batches(src).mapInArrow(run, f"id {kind}, part int, local_start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
