"""Source text around lines, as DataFrames of (file, line, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source_lines(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """(file, line, text) of files below a root, line 0-based; files that don't exist are left out."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    there = []
    for f in files:
        path = hadoop.Path(f"{root.rstrip('/')}/{f}")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            there.append((path.toString(), fs.makeQualified(path).toUri().toString(), f))  # as it is read, and as rows name it
    if not there:
        return spark.createDataFrame([], "file string, line int, text string")
    known = spark.createDataFrame([(re.sub("^file:/+", "file:/", p), f) for _, p, f in there], "path string, file string")
    texts = spark.read.text([p for p, _, _ in there], wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), "value")
    return texts.join(F.broadcast(known), "path").select("file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line", "text"))


def tree_lines(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(file, line, text) of all files below a root, or of those that a table (column file) names, found in the scan itself and
    not one by one on the driver; lines 0-based, none in an empty file. Files are split into lines where they were read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(root)
    base = re.sub("^file:/+", "file:/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()).rstrip("/")
    texts = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    here = F.substring(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), len(base) + 2, 1 << 20)
    texts = texts.select(F.url_decode(F.replace(here, F.lit("+"), F.lit("%2B"))).alias("file"), "value")
    if files is not None:
        texts = texts.join(files.select("file").distinct(), "file", "left_semi")
    return texts.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line", "text"))


def windows(sites: DataFrame, context: int = 3) -> DataFrame:
    """(file, line): the lines within `context` of the sites (file, line), each once."""
    return sites.filter("file is not null and line is not null").select("file", F.explode(F.sequence(F.greatest(F.col("line") - context, F.lit(0)), F.col("line") + context)).alias("line")).distinct()


def merged_source(lines: DataFrame, sites: DataFrame, context: int = 3) -> DataFrame:
    """(file, line1, text, is_use) of the merged windows around sites, lines 1-based."""
    uses = sites.select("file", "line").distinct().withColumn("is_use", F.lit(True))
    return lines.join(windows(sites, context), ["file", "line"], "left_semi").join(uses, ["file", "line"], "left").select("file", (F.col("line") + 1).alias("line1"), "text", F.coalesce("is_use", F.lit(False)).alias("is_use")).orderBy("file", "line1")


def lines_by_file(sites: DataFrame) -> DataFrame:
    """(file, lines): the sorted lines of the sites of each file; a file's list is bounded by its length."""
    return sites.select("file", "line").distinct().groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def signature(text: Column) -> Column:
    """The first balanced parenthesis of a text with white space collapsed, or null."""
    at = F.instr(text, "(")
    tail = F.split(F.substring(text, at, F.length(text)), "")
    step = lambda acc, c: F.when(acc["done"], acc).otherwise(F.struct((acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), F.concat(acc["text"], c).alias("text"), ((c == ")") & (acc["depth"] == 1)).alias("done")))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("done"))
    got = F.aggregate(tail, start, step, lambda acc: F.when(acc["done"], F.trim(F.regexp_replace(acc["text"], r"\s+", " "))))
    return F.when(at > 0, got)


def signatures(lines: DataFrame, sites: DataFrame, depth: int = 8) -> DataFrame:
    """sites (file, line, ...) with signature, read from the definition line and the `depth` lines after it."""
    near = sites.select("file", "line").distinct().select("file", F.col("line").alias("at")).join(lines, "file").filter((F.col("line") >= F.col("at")) & (F.col("line") <= F.col("at") + depth))
    text = near.groupBy("file", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))
    return sites.join(text.select("file", F.col("at").alias("line"), signature(F.col("text")).alias("signature")), ["file", "line"], "left")
