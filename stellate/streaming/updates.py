"""Stores that follow streams of partial indexes.

`follow_indexes` takes the indexes that appear in a folder. `follow` takes the three tables of an index as streams of their
own, whose rows of one document may come in any order and in different batches: they are joined by document and revision
and handed on when the watermark has passed the revision, whole documents at a time. A document counts with its latest
revision, however batches cut it; a batch that is run again replaces the same files with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stellate import schema
from stellate.operators import derive, store
from stellate.session import cut, settings
from stellate.sources import scip

TABLES = {"occurrences": schema.OCCURRENCES, "symbol_info": schema.SYMBOL_INFO, "relationships": schema.RELATIONSHIPS, "documents": schema.DOCUMENTS}
DELAY = "1 minute"
#: Rows of a stream have no size that plans know, and a batch's session plans nothing anew: joins would broadcast whole tables. Only
#: what was counted as small is, where a join says so.
JOINS = {"spark__sql__adaptive__enabled": "true", "spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


def take(spark: SparkSession, path: str, index: dict[str, DataFrame], **how) -> store.UpdateStats | None:
    """Updates the store with the documents of an index; None if it has none."""
    docs = index["documents"].select("doc").distinct()
    if docs.isEmpty():
        return None
    built = derive.build(index["occurrences"], index["symbol_info"], index["relationships"], keep=cut, **how)
    return store.update(spark, path, built, docs)


def _start(rows: DataFrame, one: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    def planned(batch: DataFrame, k: int) -> None:
        with settings(batch.sparkSession, **JOINS):
            one(batch, k)

    stream = rows.writeStream.foreachBatch(planned).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def follow_indexes(spark: SparkSession, folder: str, path: str, checkpoint: str, available_now: bool = True, attribute: bool = False) -> StreamingQuery:
    """Applies each index file that appears in `folder` to the store at `path`. The stream carries names; the bytes are read
    as read_index does."""
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def one(batch: DataFrame, _: int) -> None:
        for f in sorted(r["path"] for r in batch.collect()):  # names of new files; each index is whole documents
            index = {k: df.checkpoint() for k, df in scip.read_index(batch.sparkSession, f).items()}
            take(batch.sparkSession, path, index, attribute_references=attribute)

    return _start(names, one, checkpoint, available_now)


def gathered(streams: dict[str, DataFrame], delay: str = DELAY) -> DataFrame:
    """(doc, revision, rows): the streams (schema.py's tables, each with a revision timestamp) joined by document and revision, when
    the watermark has passed. A row of another stream than `documents` keeps its columns in a struct of its table's name."""
    parts = []
    for name, df in streams.items():
        columns = [c.split()[0] for c in TABLES[name].split(", ") if c.split()[0] != "doc"]
        own = [F.struct(*columns).alias(n) if n == name else F.lit(None).cast(_struct(n)).alias(n) for n in TABLES]
        parts.append(df.select("doc", "revision", *own))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rows = F.collect_list(F.struct(*TABLES)).alias("rows")
    by = every.withWatermark("revision", delay).groupBy("doc", "revision").agg(rows)
    return by.select("doc", "revision", "rows")


def _struct(name: str) -> str:
    return "struct<" + ",".join(":".join(c.split()) for c in TABLES[name].split(", ") if c.split()[0] != "doc") + ">"


def unpacked(batch: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index from rows of `gathered`, of each document its latest revision."""
    latest = Window.partitionBy("doc").orderBy(F.desc("revision"))
    one = batch.withColumn("k", F.row_number().over(latest)).filter("k = 1").select("doc", F.explode("rows").alias("r"))
    return {name: one.filter(F.col(f"r.{name}").isNotNull()).select("doc", f"r.{name}.*").select(*(c.split()[0] for c in schema_.split(", "))) for name, schema_ in TABLES.items()}


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str, available_now: bool = True, delay: str = DELAY, attribute: bool = False) -> StreamingQuery:
    """Applies the Parquet files that appear in the folders occurrences, symbol_info, relationships and documents of `folder` (the
    tables of schema.py and a revision timestamp) to the store at `path`.

    Each document of a revision has a row in `documents`, even one without anything else, which empties its file. Rows that
    come later than `delay` behind the newest revision seen are late, and the watermark drops them. A revision is handed on
    once something newer than it by `delay` has come.
    """
    streams = {name: spark.readStream.schema(f"{s}, revision timestamp").parquet(f"{folder}/{name}") for name, s in TABLES.items()}

    def one(batch: DataFrame, _: int) -> None:
        index = {k: df.checkpoint() for k, df in unpacked(batch).items()}
        take(batch.sparkSession, path, index, attribute_references=attribute)

    return _start(gathered(streams, delay), one, checkpoint, available_now)
