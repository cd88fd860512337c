"""A graph made of the driver's tables, for queries that SQL engines can check.

Parts are functions, consecutive lines of an order call each other, customers derive from nations and nations from
regions, suppliers implement parts, events are occurrences in documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate.functions.paths import is_test_file

UNIT_BASE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("cxx . . $ "), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(")."))
    return p.select(F.col("p_partkey").alias("id"), name.alias("symbol"), F.col("p_name").alias("display_name"), F.col("p_partkey").alias("file_id"), F.col("p_size").alias("line"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    path = F.concat(F.when(F.col("p_size") % 5 == 0, "vendor/").otherwise("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 7 == 0, "_test.cpp").otherwise(".cpp"))
    units = o.select((F.col("o_orderkey") + UNIT_BASE).alias("id"), F.concat(F.lit("src/unit/o"), F.col("o_orderkey").cast("string"), F.lit(".cpp")).alias("path"))
    return p.select(F.col("p_partkey").alias("id"), path.alias("path")).unionByName(units).withColumn("is_test", is_test_file(F.col("path")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of an order call each other. Lines move once, by their order: both sides of the join read the same
    shuffle, and equal calls lie together behind it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("src_id"))
    b = li.select("l_orderkey", F.col("l_linenumber").alias("after"), F.col("l_partkey").alias("dst_id"))
    pairs = a.join(b, "l_orderkey").filter("after - line = 1").select("l_orderkey", "line", "src_id", "dst_id").distinct()
    return pairs.select(F.lit("calls").alias("kind"), "src_id", "dst_id", (F.col("l_orderkey") + UNIT_BASE).alias("file_id"), "line")


def implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("implements").alias("kind"), F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("int").alias("line")).distinct()


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the inheritance tree: customers, nations, regions in one id space."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    one = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("cxx . . $ cust/C"), F.col("c_custkey").cast("string"), F.lit("#")).alias("symbol"))
    two = n.select((F.col("n_nationkey").cast("long") + UNIT_BASE).alias("id"), F.concat(F.lit("cxx . . $ nation/"), F.col("n_name"), F.lit("#")).alias("symbol"))
    three = r.select((F.col("r_regionkey").cast("long") + 2 * UNIT_BASE).alias("id"), F.concat(F.lit("cxx . . $ region/"), F.col("r_name"), F.lit("#")).alias("symbol"))
    return one.unionByName(two).unionByName(three).select("id", "symbol", F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("int").alias("line"))


def inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    one = c.select(F.col("c_custkey").alias("src_id"), (F.col("c_nationkey").cast("long") + UNIT_BASE).alias("dst_id"))
    two = n.select((F.col("n_nationkey").cast("long") + UNIT_BASE).alias("src_id"), (F.col("n_regionkey").cast("long") + 2 * UNIT_BASE).alias("dst_id"))
    return one.unionByName(two).select(F.lit("inherits").alias("kind"), "src_id", "dst_id", F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("int").alias("line"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as occurrences: a document for each user, a line for each event in time order."""
    e = table(spark, sf_dir, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    body = F.when((F.col("event_type") == "signup") & (k % 3 > 0), k % 20)
    kind = F.col("event_type")
    name = F.when(kind.isin("signup", "purchase", "error"), F.concat(F.lit("cxx . . $ fn/f"), (k % 40).cast("string"), F.lit("(). "))).otherwise(F.concat(F.lit("cxx . . $ ty/T"), (k % 40).cast("string"), F.lit("#")))
    roles = F.when(kind == "signup", 1).when(kind == "error", 64).otherwise(0)
    return e.select(F.col("user_id").alias("doc_ord"), F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".cpp")).alias("doc"), F.col("event_id").alias("occ_ord"), F.rtrim(name).alias("symbol"), roles.cast("int").alias("symbol_roles"), line.cast("int").alias("line"), F.when(body.isNotNull(), line).cast("int").alias("enc_start"), (line + body).cast("int").alias("enc_end"))


def symbol_info(spark: SparkSession, sf_dir: str, occ: DataFrame | None = None) -> DataFrame:
    """A row for each document and symbol; some names are empty. `occ`: the occurrences, where they were made before."""
    o = (occurrences(spark, sf_dir) if occ is None else occ).groupBy("doc_ord", "doc", "symbol").agg(F.min("occ_ord").alias("sym_ord"))
    return o.select("doc_ord", "doc", "sym_ord", "symbol", F.when(F.col("sym_ord") % 3 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("sym_ord") % 5).cast("string"))).alias("display_name"))


def relationships(spark: SparkSession, sf_dir: str, info: DataFrame | None = None) -> DataFrame:
    """From each symbol of a document to one of the demo's types or functions. `info`: symbol_info, where it was made before."""
    i = symbol_info(spark, sf_dir) if info is None else info
    dst = F.when(F.col("sym_ord") % 4 < 3, F.concat(F.lit("cxx . . $ ty/T"), (F.col("sym_ord") % 40).cast("string"), F.lit("#"))).otherwise(F.concat(F.lit("cxx . . $ fn/f"), (F.col("sym_ord") % 40).cast("string"), F.lit("().")))
    return i.select("doc_ord", "doc", F.col("sym_ord").alias("rel_ord"), F.col("symbol").alias("src"), dst.alias("dst"), (F.col("sym_ord") % 2 == 1).alias("is_implementation"))
