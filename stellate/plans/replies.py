"""Replies: bounded answers with the true totals, as one-row DataFrames, and usage graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.paths import basename, file_node_id, is_test_file, path_ok
from stellate.functions.symbols import display_label, is_noise, is_trivial_callee, is_type_query, line1, loosen_to_leaf, qualified_name, short_label
from stellate.plans import traverse
from stellate.plans.graph import HOTSPOT_KINDS, CodeGraph, filtered
from stellate.schema import CALLS, INHERITS
from stellate.sources import snippets

DEFAULT_LIMIT, EXPLAIN_LIMIT = 40, 10


def reply(rows: DataFrame, limit: int, order: list, **more) -> DataFrame:
    """One row: total, truncated, results (the first `limit` rows in order), and constants. Only the rows that are shown
    are gathered; the total is a count."""
    shown = rows.orderBy(*order).limit(limit).withColumn("_k", F.monotonically_increasing_id())
    inner = F.struct("_k", F.struct(*rows.columns).alias("row"))
    packed = shown.agg(F.transform(F.sort_array(F.collect_list(inner)), lambda x: x["row"]).alias("results"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = total.crossJoin(packed).select("total", (F.col("total") > limit).alias("truncated"), "results")  # one row each
    return out.withColumns({k: F.lit(None).cast("string") if v is None else F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in more.items()})


def ambiguity(graph: CodeGraph, query: str, limit: int = 10) -> tuple[str | None, DataFrame | None]:
    """(symbol, None), or (None, reply) with the candidates, or a reply without any."""
    symbol, found = graph.resolve(query)
    if symbol is not None:
        return symbol, None
    if found is None:
        found = graph.find("")
    many = not found.isEmpty()
    hint = "pass one of the candidates" if many else "no such symbol; try find"
    return None, reply(found, limit, ["file", "line", "symbol"], ambiguous=many, query=query, hint=hint)


def find(graph: CodeGraph, query: str, limit: int = DEFAULT_LIMIT, hide_trivial: bool = False, include_paths=None, exclude_paths=None, root: str | None = None) -> DataFrame:
    """Groups of overloads: total (matches), groups, truncated, relaxed (null, fuzzy or leaf), trivial_hidden, results.

    With a root, members of groups in the first `limit` files carry the signature at their definition. Where nothing matches exactly, fuzzy matches are shown, else matches of the last name of a qualified query. The cap is
    on groups; groups come in the order of their first match."""
    leaf = loosen_to_leaf(query)
    tries = [(query, False, None), (query, True, "fuzzy"), *([(leaf, False, "leaf"), (leaf, True, "leaf")] if leaf else [])]
    relaxed, found = None, graph.find(query)
    for text, fuzzy, how in tries:
        here = graph.find(text, fuzzy)
        if not here.isEmpty():
            relaxed, found = how, here
            break
    hidden = 0
    if hide_trivial:
        hidden = found.filter(is_noise(F.col("symbol"))).count()
        found = found.filter(~is_noise(F.col("symbol")))
    if include_paths or exclude_paths:
        found = found.filter(path_ok(F.col("file"), include_paths, exclude_paths))
    if root is not None:
        spark = graph.symbols.sparkSession
        shown = [r["file"] for r in found.filter("file is not null").select("file").distinct().orderBy("file").limit(limit).collect()]
        found = snippets.signatures(snippets.source_lines(spark, root, shown), found)
    groups = overload_groups(found)
    total = found.agg(F.count(F.lit(1)).alias("matches"))
    out = reply(groups, limit, ["first"], query=query, relaxed=relaxed, relaxed_query=leaf if relaxed == "leaf" else None, trivial_hidden=hidden)
    return out.withColumnRenamed("total", "groups").crossJoin(total).withColumnRenamed("matches", "total")  # one row each


def overload_groups(nodes: DataFrame) -> DataFrame:
    """(qualified, overloads, first, signatures): symbols that share a qualified name."""
    return nodes.groupBy(qualified_name(F.col("symbol")).alias("qualified")).agg(F.count(F.lit(1)).alias("overloads"), F.min("symbol").alias("first"), F.sort_array(F.collect_list(F.struct("symbol", "file", "line", *(c for c in ("signature",) if c in nodes.columns)))).alias("signatures"))


def _source(graph: CodeGraph, sites: DataFrame, root: str, context: int, limit: int) -> DataFrame:
    """One row, source: the merged windows around the first `limit` sites (file, line), grouped by file."""
    few = sites.filter("file is not null and line is not null").orderBy("file", "line").limit(limit)
    rows = few.select("file", "line").collect()  # bounded by limit
    spark = graph.symbols.sparkSession
    lines = snippets.source_lines(spark, root, sorted({r["file"] for r in rows}))
    found = snippets.merged_source(lines, spark.createDataFrame([tuple(r) for r in rows], "file string, line int"), context)
    per = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line1", "text", "is_use"))).alias("lines"))
    return per.agg(F.sort_array(F.collect_list(F.struct("file", "lines"))).alias("source"))


def _edges(graph: CodeGraph, query: str, near: str, limit: int, full_symbols: bool, exclude_tests: bool, hide_trivial: bool, include_paths, exclude_paths) -> DataFrame:
    symbol, other = ambiguity(graph, query)
    if symbol is None:
        return other
    e = filtered(graph._near(symbol, CALLS, near), exclude_tests, include_paths, exclude_paths)
    hidden = 0
    if hide_trivial:
        hidden = e.filter(is_trivial_callee(F.col("far"))).count()
        e = e.filter(~is_trivial_callee(F.col("far")))
    name = F.col("far") if full_symbols else short_label(F.col("far"))
    return reply(e.select(name.alias("symbol"), "file", line1(F.col("line")).alias("line")), limit, ["file", "line", "symbol"], symbol=symbol, trivial_hidden=hidden)


def callers(graph: CodeGraph, query: str, limit: int = DEFAULT_LIMIT, full_symbols: bool = False, exclude_tests: bool = True, include_paths=None, exclude_paths=None) -> DataFrame:
    return _edges(graph, query, "dst_id", limit, full_symbols, exclude_tests, False, include_paths, exclude_paths)


def callees(graph: CodeGraph, query: str, limit: int = DEFAULT_LIMIT, full_symbols: bool = False, exclude_tests: bool = True, hide_trivial: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
    return _edges(graph, query, "src_id", limit, full_symbols, exclude_tests, hide_trivial, include_paths, exclude_paths)


def _types(graph: CodeGraph, query: str, up: bool, limit: int, full_symbols: bool) -> DataFrame:
    symbol, other = ambiguity(graph, query)
    if symbol is None:
        return other
    found = graph.bases(symbol) if up else graph.subtypes(symbol)
    note = None if not found.isEmpty() else f"no {'base types' if up else 'subtypes'} are indexed; override edges between methods are not listed here"
    return reply(found.select(display_label(F.col("symbol"), F.lit(None).cast("string"), full_symbols).alias("symbol"), "file", line1(F.col("line")).alias("line")), limit, ["file", "line", "symbol"], symbol=symbol, note=note)


def bases(graph: CodeGraph, query: str, limit: int = DEFAULT_LIMIT, full_symbols: bool = False) -> DataFrame:
    return _types(graph, query, True, limit, full_symbols)


def subtypes(graph: CodeGraph, query: str, limit: int = DEFAULT_LIMIT, full_symbols: bool = False) -> DataFrame:
    return _types(graph, query, False, limit, full_symbols)


def references(graph: CodeGraph, query: str, limit: int = DEFAULT_LIMIT, exclude_tests: bool = True, include_paths=None, exclude_paths=None, root: str | None = None, context: int = 0) -> DataFrame:
    """Use sites; with a root also source, the lines around those that are shown."""
    symbol, other = ambiguity(graph, query)
    if symbol is None:
        return other
    available = graph.refs is not None and not graph.refs.isEmpty()
    r = graph.references(symbol, exclude_tests, include_paths, exclude_paths)
    out = reply(r.select("file", line1(F.col("line")).alias("line"), short_label(F.col("enclosing")).alias("used_by")), limit, ["file", "line"], symbol=symbol, available=available)
    return out if root is None else out.crossJoin(_source(graph, r, root, context, limit))  # one row each


def call_path(graph: CodeGraph, src: str, dst: str) -> DataFrame:
    """One row: found, hops, nodes from src to dst (the first without a site), hint."""
    spark = graph.edges.sparkSession
    one, other = ambiguity(graph, src)
    if one is None:
        return other
    two, other = ambiguity(graph, dst)
    if two is None:
        return other
    path = traverse.shortest_call_path(graph, one, two)
    schema = "found boolean, hops int, nodes array<struct<symbol string, file string, line int>>, hint string"
    if path is None:
        return spark.createDataFrame([(False, None, [], "no static call path; virtual calls and callbacks are not followed")], schema)
    steps = [(r["dst"], r["file"], None if r["line"] is None else r["line"] + 1) for r in path.collect()]  # as many as hops
    return spark.createDataFrame([(True, len(steps), [(one, None, None), *steps], None)], schema)


def impact(graph: CodeGraph, query: str, depth: int | None = None, limit: int = DEFAULT_LIMIT, kind: str = CALLS, full_symbols: bool = False, exclude_tests: bool = True, include_paths=None, exclude_paths=None) -> DataFrame:
    """Everything that reaches the symbol, sorted by symbol, filtered by definition file. For calls to a type, which
    nothing calls, the reply points to its references instead."""
    symbol, other = ambiguity(graph, query)
    if symbol is None:
        return other
    if kind == CALLS and graph.symbols.sparkSession.range(1).select(is_type_query(F.lit(symbol))).first()[0]:
        n = graph.references(symbol).count()
        none = graph.symbols.limit(0).select("symbol", F.lit("").alias("file"), "line")
        return reply(none, limit, ["symbol"], symbol=symbol, is_type=True, reference_sites=n, notice=f"a type is not called; see its references, or the impact along {INHERITS}")
    found = traverse.impact(graph, symbol, depth, kind).join(graph.sites().select("symbol", "file", "line"), "symbol")
    if exclude_tests:
        found = found.filter(~is_test_file(F.col("file")))
    if include_paths or exclude_paths:
        found = found.filter(path_ok(F.col("file"), include_paths, exclude_paths))
    shown = found.select("symbol", "file", line1(F.col("line")).alias("line"))
    out = reply(shown, limit, ["symbol"], symbol=symbol, is_type=False, reference_sites=None, notice=None)
    if full_symbols:
        return out
    return out.withColumn("results", F.transform("results", lambda x: F.struct(short_label(x["symbol"]).alias("symbol"), x["file"].alias("file"), x["line"].alias("line"))))


def hotspots(graph: CodeGraph, limit: int = DEFAULT_LIMIT, kind: str = "fan_in", exclude_tests: bool = False, full_symbols: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
    if kind not in HOTSPOT_KINDS or limit < 0:
        raise ValueError(f"kind is one of {HOTSPOT_KINDS}, limit isn't negative")
    d = graph.degrees(kind, exclude_tests, include_paths, exclude_paths).join(graph.sites(), "id")
    name = F.col("symbol") if full_symbols else display_label(F.col("symbol"), F.col("display_name"))
    return reply(d.select(F.col("symbol").alias("key"), name.alias("symbol"), "file", line1(F.col("line")).alias("line"), "n"), limit, [F.desc("n"), "key"], kind=kind)


def explain(graph: CodeGraph, symbol: str, limit: int = EXPLAIN_LIMIT, full_symbols: bool = False, exclude_tests: bool = True, hide_trivial: bool = False, root: str | None = None, context: int = 3) -> DataFrame:
    """One row: the node's site, callers and callees, each capped, excluded_tests; with a root also the source around the
    site. A symbol that isn't known gives one row with an error."""
    found = graph.get_node(symbol)
    if found.isEmpty():
        return graph.symbols.sparkSession.createDataFrame([(f"no symbol {symbol!r}; try find",)], "error string")
    node = found.select(F.struct("symbol", "display_name", "file", line1(F.col("line")).alias("line")).alias("node"), F.lit(exclude_tests).alias("excluded_tests"))
    one = _edges(graph, symbol, "dst_id", limit, full_symbols, exclude_tests, hide_trivial, None, None)
    two = _edges(graph, symbol, "src_id", limit, full_symbols, exclude_tests, hide_trivial, None, None)
    out = node.crossJoin(one.select(F.struct(*one.columns).alias("callers"))).crossJoin(two.select(F.struct(*two.columns).alias("callees")))  # one row each
    return out if root is None else out.crossJoin(_source(graph, found, root, context, 1))


def usage_by_file(graph: CodeGraph, symbol: str) -> DataFrame:
    """(source, target, label, relation, weight): one link for each file that uses the symbol."""
    r = graph.references(symbol).filter("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("weight"))
    return r.select(F.lit(symbol).alias("source"), file_node_id(F.col("file")).alias("target"), basename(F.col("file")).alias("label"), F.lit("references").alias("relation"), "weight").orderBy("target")


def usage_by_symbol(graph: CodeGraph, symbol: str) -> DataFrame:
    """As usage_by_file, with the enclosing symbol in place of the file where it is known."""
    r = graph.references(symbol).filter("enclosing is not null or file is not null")
    known = F.col("enclosing").isNotNull()
    target = F.when(known, F.col("enclosing")).otherwise(file_node_id(F.col("file")))
    label = F.when(known, short_label(F.col("enclosing"))).otherwise(basename(F.col("file")))
    return r.select(target.alias("target"), label.alias("label"), F.when(known, "used_by").otherwise("references").alias("relation")).groupBy("target", "label", "relation").agg(F.count(F.lit(1)).alias("weight")).select(F.lit(symbol).alias("source"), "target", "label", "relation", "weight").orderBy(F.desc("relation"), "target")


def usage(graph: CodeGraph, symbol: str) -> DataFrame:
    """By symbol if any use is attributed, else by file."""
    return usage_by_file(graph, symbol) if graph.references(symbol).filter("enclosing is not null").isEmpty() else usage_by_symbol(graph, symbol)


def export(graph: CodeGraph, symbol: str, depth: int = 2, direction: str = "both", exclude_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a neighbourhood; without tests, edges between the nodes that stay."""
    nodes, edges = traverse.subgraph(graph, symbol, depth, direction)
    if exclude_tests:
        nodes = nodes.filter(~is_test_file(F.col("file")))
        keep = nodes.select("symbol")
        edges = edges.join(keep.withColumnRenamed("symbol", "src"), "src", "left_semi").join(keep.withColumnRenamed("symbol", "dst"), "dst", "left_semi")
    return nodes, edges.select("kind", "src", "dst", "file", "line")


def status(graph: CodeGraph, drift: DataFrame | None = None, limit: int = DEFAULT_LIMIT) -> dict:
    """meta, the granularity of usage views, and with drift (path, state) the verdict and capped lists."""
    from stellate.functions.paths import is_source_file
    from stellate.operators.freshness import staleness_verdict

    meta = graph.meta or {}
    view = "none" if meta.get("has_references") != "true" else "symbol" if meta.get("has_attributed_refs") == "true" else "file"
    out = {"meta": meta, "usage_view": view, "indexed_files": graph.files.count()}
    if drift is not None:
        d = drift.filter(is_source_file(F.col("path")))
        n = {r["state"]: r["n"] for r in d.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        out |= staleness_verdict(n.get("changed", 0), n.get("deleted", 0), out["indexed_files"])
        out["files"] = {s: [r["path"] for r in d.filter(F.col("state") == s).orderBy("path").select("path").limit(limit).collect()] for s in n}
    return out
