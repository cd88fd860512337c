"""Derivation of a graph from an index: definition sites, calls, hierarchy and references.

Inputs are the tables of schema.py: occurrences, symbol_info, relationships. Everything is one lazy plan; attribution
works inside documents, so that its shuffles are by document, and no document is gathered in one task: the containment
join and the search for the nearest definition are both by document and line bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellate.functions.symbols import is_callable, is_local, is_type
from stellate.schema import CALLS, DEFINITION, FORWARD_DEFINITION, IMPLEMENTS, INHERITS

BUCKET = 256  # lines


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(DEFINITION) != 0


def is_use(roles: Column) -> Column:
    return roles.bitwiseAND(DEFINITION | FORWARD_DEFINITION) == 0


def definition_sites(occurrences: DataFrame) -> DataFrame:
    """(symbol, file, line) of the first definition of each symbol in document and occurrence order."""
    d = occurrences.filter(is_definition(F.col("symbol_roles")) & F.col("line").isNotNull())
    first = F.min_by(F.struct(F.col("doc").alias("file"), "line"), F.struct("doc_ord", "occ_ord")).alias("site")
    return d.groupBy("symbol").agg(first).select("symbol", "site.file", "site.line")


def display_names(symbol_info: DataFrame) -> DataFrame:
    """(symbol, display_name): every symbol with its first name that isn't empty, or null."""
    order = F.when(F.coalesce("display_name", F.lit("")) != "", F.struct("doc_ord", "sym_ord"))
    return symbol_info.groupBy("symbol").agg(F.min_by("display_name", order).alias("display_name"))


def relationship_edges(relationships: DataFrame) -> DataFrame:
    """Edges of implementations: between two types inherits, else implements; without a line."""
    kind = F.when(is_type(F.col("src")) & is_type(F.col("dst")), INHERITS).otherwise(IMPLEMENTS)
    return relationships.filter("is_implementation").select(kind.alias("kind"), "src", "dst", F.col("doc").alias("file"), F.lit(None).cast("int").alias("line")).distinct()


def intervals(occurrences: DataFrame, kinds: Column) -> DataFrame:
    """Definitions with a body whose symbol is of the kinds: (doc, start, end, ord, container)."""
    d = occurrences.filter(is_definition(F.col("symbol_roles")) & kinds & F.col("line").isNotNull() & F.col("enc_start").isNotNull())
    return d.select("doc", F.col("enc_start").alias("start"), F.col("enc_end").alias("end"), F.struct("doc_ord", "occ_ord").alias("ord"), F.col("symbol").alias("container"))


def bodies(occurrences: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(file, bucket, start, end, doc_ord, occ_ord, symbol): callable and type bodies, a row for each line bucket that they touch."""
    d = intervals(occurrences, is_callable(F.col("symbol")) | is_type(F.col("symbol"))).filter(F.col("end") >= F.col("start"))
    touched = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("bucket")
    return d.select(F.col("doc").alias("file"), touched, "start", "end", "ord.doc_ord", "ord.occ_ord", F.col("container").alias("symbol"))


def innermost(sites: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds container to sites (doc, line, ...): of the spans that hold the line, ends included, the one with the
    greatest start, the later one of equal starts; null where there is none.

    Spans are laid out over line buckets and sites meet them by document and bucket, so that the join is an equi-join
    and a long document is dealt over tasks.
    """
    wide = spans.filter(F.col("end") >= F.col("start")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    points = sites.select("doc", "line").distinct().withColumn("bucket", F.floor(F.col("line") / bucket))
    held = points.join(wide, ["doc", "bucket"]).filter((F.col("start") <= F.col("line")) & (F.col("line") <= F.col("end")))
    best = held.groupBy("doc", "line").agg(F.max_by("container", F.struct("start", "ord")).alias("container"))
    return sites.join(best, ["doc", "line"], "left")


def preceding(sites: DataFrame, definitions: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds container to sites (doc, line, ...): the last definition (doc, line, symbol) at or before the line, the
    greatest symbol of one line.

    A window over a document's line buckets, of which each has a row, carries the last definition on from bucket to
    bucket; one over the lines of a bucket finds the nearest in it. No task gathers a document.
    """
    at = F.floor(F.col("line") / bucket).alias("bucket")
    d = definitions.select("doc", "line", F.col("symbol").alias("name")).groupBy("doc", "line").agg(F.max("name").alias("name"))
    both = d.select("doc", at, "line", "name", F.lit(0).alias("at")).unionByName(sites.select("doc", at, "line").distinct().select("doc", "bucket", "line", F.lit(None).cast("string").alias("name"), F.lit(1).alias("at")))
    last = both.groupBy("doc", "bucket").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("line"))).alias("last"))
    earlier = Window.partitionBy("doc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("doc", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    here = Window.partitionBy("doc", "bucket").orderBy("line", "at").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("name", ignorenulls=True).over(here)).filter("at = 1").select("doc", "bucket", "line", "near")
    found = near.join(carried, ["doc", "bucket"]).select("doc", "line", F.coalesce("near", "before").alias("container"))
    return sites.join(found, ["doc", "line"], "left")


def call_edges(occurrences: DataFrame) -> DataFrame:
    """Calls: uses of callables, attributed to the innermost callable body; in a document without any such body to the
    nearest definition of a callable before. A call outside of all bodies of a document that has some is dropped, as
    its nearest definition would be a mere neighbour."""
    named = is_callable(F.col("symbol")) & F.col("line").isNotNull()
    sites = occurrences.filter(named & is_use(F.col("symbol_roles"))).select("doc", "line", F.col("symbol").alias("dst")).distinct()
    spans = intervals(occurrences, is_callable(F.col("symbol")))
    with_bodies = spans.select("doc").distinct()
    inside = innermost(sites.join(with_bodies, "doc", "left_semi"), spans)
    defs = occurrences.filter(named & is_definition(F.col("symbol_roles"))).select("doc", "line", "symbol")
    before = preceding(sites.join(with_bodies, "doc", "left_anti"), defs.join(with_bodies, "doc", "left_anti"))
    return inside.unionByName(before).filter("container is not null").select(F.lit(CALLS).alias("kind"), F.col("container").alias("src"), "dst", F.col("doc").alias("file"), "line").distinct()


def references(occurrences: DataFrame, attribute: bool = False) -> DataFrame:
    """Uses of symbols that aren't local: (symbol, file, line, enclosing), once each. With `attribute`, enclosing is the
    innermost callable or type body of the first such use in document and occurrence order."""
    uses = occurrences.filter(is_use(F.col("symbol_roles")) & ~is_local(F.col("symbol")) & F.col("line").isNotNull())
    first = uses.groupBy("symbol", "doc", "line").agg(F.min(F.struct("doc_ord", "occ_ord")).alias("ord"))
    if attribute:
        kinds = is_callable(F.col("symbol")) | is_type(F.col("symbol"))
        first = innermost(first, intervals(occurrences, kinds))
    else:
        first = first.withColumn("container", F.lit(None).cast("string"))
    return first.select("symbol", F.col("doc").alias("file"), "line", F.col("container").alias("enclosing"))


def build(occurrences: DataFrame, symbol_info: DataFrame, relationships: DataFrame, include_references: bool = True, attribute_references: bool = False, drop_locals: bool = False, spans: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """nodes (symbol, display_name, file, line), edges (kind, src, dst, file, line), refs (symbol, file, line,
    enclosing), and with `spans` those of bodies, by name. Every end of an edge and every referenced symbol is a node. `keep` (such as session.cut) is applied to the
    tables, so that edges and references are derived once for all that reads them."""
    edges = keep(relationship_edges(relationships).unionByName(call_edges(occurrences)))
    refs = references(occurrences, attribute_references)
    refs = keep(refs) if include_references else refs.limit(0)
    sites = definition_sites(occurrences)
    names = display_names(symbol_info)
    every = names.select("symbol").union(sites.select("symbol")).union(edges.select("src")).union(edges.select("dst")).union(refs.select("symbol")).distinct()
    nodes = every.join(names, "symbol", "left").join(sites, "symbol", "left").select("symbol", "display_name", "file", "line")
    if drop_locals:
        nodes = nodes.filter(~is_local(F.col("symbol")))
    return {"nodes": keep(nodes), "edges": edges, "refs": refs} | ({"spans": bodies(occurrences)} if spans else {})
