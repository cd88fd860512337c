"""What lies where: the symbol whose body holds a line of a file, from intervals that a store keeps by file and line bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.operators.derive import BUCKET
from stellate.plans.graph import CodeGraph

FEW = 1000  # buckets that reach the scan as literals


def symbols_at(graph: CodeGraph, sites: DataFrame) -> DataFrame:
    """sites (file, line, ...), lines 0-based -> their columns and symbol: the innermost callable or type body that holds the
    line, ends included, the later one of equal starts; null where none does, or the file is unknown.

    Sites meet intervals by file and line bucket, which a long file is dealt over; a few sites read their own row groups.
    """
    if graph.spans is None:
        raise ValueError("the store keeps no intervals; build it with spans")
    at = sites.select("file", "line").filter("line is not null").distinct().withColumn("bucket", F.floor(F.col("line") / BUCKET))
    known = at.join(graph.files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file")
    spans = graph.spans
    places = known.select("file_id", "bucket").distinct().limit(FEW + 1).collect()
    if len(places) <= FEW:
        spans = spans.filter(F.col("file_id").isin([p["file_id"] for p in places]) & F.col("bucket").isin([p["bucket"] for p in places]))
    held = known.join(spans, ["file_id", "bucket"]).filter((F.col("start") <= F.col("line")) & (F.col("line") <= F.col("end")))
    best = held.groupBy("file", "line").agg(F.max_by("symbol_id", F.struct("start", "doc_ord", "occ_ord")).alias("id"))
    named = best.join(graph.symbols.select("id", "symbol"), "id").select("file", "line", "symbol")
    return sites.join(named, ["file", "line"], "left")
