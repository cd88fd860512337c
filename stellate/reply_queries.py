"""Queries of replies, stores, indexes and maintenance, and the same in SQL; they join the catalogue of queries.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate import schema
from stellate.functions import paths, symbols, versions
from stellate.operators import derive, freshness, store
from stellate.plans import layers, locate, replies
from stellate.plans.graph import CodeGraph
from stellate.queries import _FN, _INSIDE, _TEST, _TY, BEFORE, FIL, HUB, INH, INSIDE, OCC, REFS, SITE, SPANS, SYM, TYPE, TYPES, _calls, _label, _near, _qualified, _reach, calls_graph, query, store_of, stored, types_graph, updated
from stellate.session import cut, fresh_path
from stellate.sources import compdb, demo, graphjson, raw, scip, snippets
from stellate.streaming import updates

CALLED = f"WITH {SYM}, {FIL}, {SITE}, {_calls()}, {HUB}"


def flat(reply: DataFrame, *more: str) -> DataFrame:
    """A row for each result of a reply, with its place and the reply's own columns."""
    return reply.select(*more, F.posexplode("results").alias("place", "x")).select(*more, "place", "x.*")


def _shown(ordered: str, rows: str, columns: str, limit: int) -> str:
    return f"SELECT {columns}, (SELECT count(*)::BIGINT FROM {rows}) AS total, (SELECT count(*) > {limit} FROM {rows}) AS truncated, (row_number() OVER (ORDER BY {ordered}) - 1)::INT AS place FROM {rows} ORDER BY {ordered} LIMIT {limit}"


@query(f"WITH {SYM}, {_calls()}, {REFS} SELECT * FROM (VALUES ('schema_version', '2'), ('has_references', 'true'), ('has_attributed_refs', 'true'), ('project_root', '/demo'), ('index_tool', 'tables'), ('source_commit', 'c0ffee')) AS t(key, value) UNION ALL SELECT 'node_count', count(*)::VARCHAR FROM sym UNION ALL SELECT 'edge_count', count(*)::VARCHAR FROM calls UNION ALL SELECT 'ref_count', count(*)::VARCHAR FROM refs UNION ALL SELECT 'attributed_ref_count', count(enclosing_id)::VARCHAR FROM refs")
def store_meta(spark, d):
    """What a store says of itself, without the time and version it was made with."""
    meta = stored(spark, d)[0].meta
    return spark.createDataFrame([(k, v) for k, v in meta.items() if k not in ("built_at", "built_with")], "key string, value string")


@query(f"WITH {_calls()} SELECT 'calls' AS kind, * FROM calls")
def store_edges(spark, d):
    return stored(spark, d, "src")[0].edges


@query(f"WITH {REFS} SELECT * FROM refs")
def store_refs(spark, d):
    return stored(spark, d)[0].refs


@query(f"{CALLED} SELECT symbol IN (SELECT symbol FROM sym) AS known, symbol AS symbol FROM (SELECT symbol FROM sym WHERE id = (SELECT id FROM hub) UNION ALL SELECT 'nosuch') t")
def has_symbol(spark, d):
    g, top = stored(spark, d)
    return spark.createDataFrame([(s, g.has_symbol(s)) for s in (top, "nosuch")], "symbol string, known boolean")


def _find_sql(where: str, relaxed: str) -> str:
    return f"WITH {SYM}, {FIL}, {SITE}, m AS (SELECT * FROM site WHERE {where}), g AS (SELECT {_qualified('symbol')} AS qualified, count(*)::BIGINT AS overloads, min(symbol) AS first FROM m GROUP BY 1) SELECT {relaxed} AS relaxed, (SELECT count(*)::BIGINT FROM m) AS total, (SELECT count(*)::BIGINT FROM g) AS groups, (SELECT count(*) > 40 FROM g) AS truncated, qualified, overloads, first FROM g ORDER BY first LIMIT 40"


def _found(reply: DataFrame) -> DataFrame:
    return flat(reply, "relaxed", "total", "groups", "truncated").select("relaxed", "total", "groups", "truncated", "qualified", "overloads", "first")


@query(_find_sql("strpos(symbol, 'widget') > 0 OR strpos(display_name, 'widget') > 0", "NULL::VARCHAR"))
def find_reply(spark, d):
    return _found(replies.find(stored(spark, d)[0], "widget"))


@query(_find_sql("strpos(symbol, 'bolt') > 0 OR strpos(display_name, 'bolt') > 0", "'leaf'"))
def find_reply_leaf(spark, d):
    """Nothing matches the qualified query; its last name does."""
    return _found(replies.find(stored(spark, d)[0], "No::Such::bolt"))


@query(_find_sql("(strpos(replace(lower(symbol), '_', ''), 'gear') > 0 OR strpos(replace(lower(display_name), '_', ''), 'gear') > 0)", "'fuzzy'"))
def find_reply_fuzzy(spark, d):
    return _found(replies.find(stored(spark, d)[0], "GE_AR", hide_trivial=True))


def _edge_reply_sql(near: str, far: str) -> str:
    rows = f"x AS (SELECT {_label('s.symbol')} AS symbol, f.path AS file, c.line + 1 AS line FROM calls c JOIN site s ON s.id = c.{far} LEFT JOIN fil f ON f.id = c.file_id WHERE c.{near} = (SELECT id FROM hub) AND NOT {_TEST.format('s.file')})"
    return f"{CALLED}, {rows} {_shown('file, line, symbol', 'x', 'symbol, file, line', 40)}"


@query(_edge_reply_sql("dst_id", "src_id"))
def callers_reply(spark, d):
    g, top = stored(spark, d)
    return flat(replies.callers(g, top), "total", "truncated")


@query(_edge_reply_sql("src_id", "dst_id"))
def callees_reply(spark, d):
    g, top = stored(spark, d, "src")
    return flat(replies.callees(g, top), "total", "truncated")


@query(f"{CALLED}, {REFS}, x AS (SELECT f.path AS file, r.line + 1 AS line, {_label('e.symbol')} AS used_by FROM refs r LEFT JOIN fil f ON f.id = r.file_id LEFT JOIN sym e ON e.id = r.enclosing_id WHERE r.symbol_id = (SELECT id FROM hub) AND NOT {_TEST.format('f.path')}) SELECT true AS available, count(*) OVER ()::BIGINT AS total, file, line, used_by FROM x")
def references_reply(spark, d):
    g, top = stored(spark, d)
    return flat(replies.references(g, top, limit=1000), "available", "total").drop("place")


@query(f"WITH {TYPES}, {INH}, x AS (SELECT {_label('b.symbol')} AS symbol, NULL::VARCHAR AS file, NULL::INT AS line FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE a.symbol = 'cxx . . $ cust/C7#') {_shown('symbol', 'x', 'symbol, file, line', 40)}")
def bases_reply(spark, d):
    return flat(replies.bases(types_graph(spark, d), "cxx . . $ cust/C7#"), "total", "truncated")


@query(f"WITH {TYPES}, {INH}, x AS (SELECT {_label('a.symbol')} AS symbol, NULL::VARCHAR AS file, NULL::INT AS line FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE b.symbol = 'cxx . . $ nation/NATION_3#') {_shown('symbol', 'x', 'symbol, file, line', 40)}")
def subtypes_reply(spark, d):
    return flat(replies.subtypes(types_graph(spark, d), "cxx . . $ nation/NATION_3#"), "total", "truncated")


@query(f"{CALLED}, a AS (SELECT s.symbol FROM calls c JOIN site s ON s.id = c.src_id WHERE c.dst_id = (SELECT id FROM hub) AND NOT {_TEST.format('s.file')}), b AS (SELECT s.symbol FROM calls c JOIN site s ON s.id = c.dst_id WHERE c.src_id = (SELECT id FROM hub) AND NOT {_TEST.format('s.file')}) SELECT symbol, display_name, file, line + 1 AS line, true AS excluded_tests, (SELECT count(*)::BIGINT FROM a) AS callers, (SELECT count(*)::BIGINT FROM b) AS callees, (SELECT least(10, count(*))::INT FROM a) AS callers_shown FROM site WHERE id = (SELECT id FROM hub)")
def explain_reply(spark, d):
    g, top = stored(spark, d)
    return replies.explain(g, top).select("node.*", "excluded_tests", F.col("callers.total").alias("callers"), F.col("callees.total").alias("callees"), F.size("callers.results").alias("callers_shown"))


@query("SELECT 'no symbol ''nosuch''; try find' AS error")
def explain_unknown(spark, d):
    return replies.explain(stored(spark, d)[0], "nosuch")


@query(f"WITH RECURSIVE {SYM}, {FIL}, {SITE}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), {_reach('dst_id', 'src_id', 'p', 'hub', 2)}, x AS (SELECT symbol AS key, {_label('symbol')} AS symbol, file, line + 1 AS line FROM site WHERE id IN (SELECT id FROM r) AND id <> (SELECT id FROM hub) AND NOT {_TEST.format('file')}) {_shown('key', 'x', 'symbol, file, line', 40)}")
def impact_reply(spark, d):
    g, top = stored(spark, d)
    return flat(replies.impact(g, top, 2), "total", "truncated")


@query(f"WITH RECURSIVE {SYM}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), lo AS (SELECT min(src_id) AS id FROM calls), {_reach('src_id', 'dst_id', 'p', 'lo', 12)} SELECT true AS found, min(depth)::INT AS hops, (min(depth) + 1)::INT AS nodes, (SELECT symbol FROM sym WHERE id = (SELECT id FROM lo)) AS first FROM r WHERE id = (SELECT id FROM hub)")
def call_path_reply(spark, d):
    g, top = stored(spark, d)
    first = g.edges.agg(F.min("src_id").alias("id")).join(g.symbols, "id").first()["symbol"]
    return replies.call_path(g, first, top).select("found", "hops", F.size("nodes").alias("nodes"), F.get("nodes", F.lit(0))["symbol"].alias("first"))


@query(f"{CALLED}, x AS (SELECT symbol AS key, coalesce(nullif(display_name, ''), {_label('symbol')}) AS symbol, file, line + 1 AS line, n FROM (SELECT dst_id AS id, count(*)::BIGINT AS n FROM calls GROUP BY dst_id) JOIN site USING (id)) {_shown('n DESC, key', 'x', 'key, symbol, file, line, n', 40)}")
def hotspots_reply(spark, d):
    return flat(replies.hotspots(stored(spark, d)[0]), "total", "truncated")


@query(f"WITH {SYM}, {FIL}, {SITE}, x AS (SELECT symbol, display_name, file, line FROM site WHERE strpos(symbol, 'Brand12#') > 0) SELECT *, true AS ambiguous FROM ({_shown('file, line, symbol', 'x', 'symbol, display_name, file, line', 10)})")
def ambiguity_reply(spark, d):
    return flat(replies.ambiguity(stored(spark, d)[0], "Brand12::")[1], "total", "truncated", "ambiguous")


@query(f"{CALLED}, {REFS}, r AS (SELECT f.path AS file, e.symbol AS enclosing FROM refs r LEFT JOIN fil f ON f.id = r.file_id LEFT JOIN sym e ON e.id = r.enclosing_id WHERE r.symbol_id = (SELECT id FROM hub)), any_ AS (SELECT count(enclosing) > 0 AS yes FROM r) SELECT target, label, relation, count(*)::BIGINT AS weight FROM (SELECT CASE WHEN yes AND enclosing IS NOT NULL THEN enclosing ELSE 'file:' || file END AS target, CASE WHEN yes AND enclosing IS NOT NULL THEN {_label('enclosing')} ELSE regexp_extract(file, '([^/]*)$', 1) END AS label, CASE WHEN yes AND enclosing IS NOT NULL THEN 'used_by' ELSE 'references' END AS relation FROM r, any_) GROUP BY ALL")
def usage_reply(spark, d):
    g, top = stored(spark, d)
    return replies.usage(g, top).select("target", "label", "relation", "weight")


@query(f"WITH {FIL}, n AS (SELECT count(*) AS files FROM fil), c AS (SELECT count(*) FILTER (WHERE id % 10 < 2) AS changed, count(*) FILTER (WHERE id % 10 = 0) AS deleted FROM fil WHERE id % 10 < 2 AND id % 7 > 0) SELECT files::BIGINT AS indexed_files, changed::BIGINT AS changed, round(changed / files, 3) AS fraction, CASE WHEN changed / files >= 0.25 THEN 'rebuild' ELSE 'update' END AS verdict, 'symbol' AS usage_view FROM n, c")
def status_drift(spark, d):
    g, _ = stored(spark, d)
    drift = g.files.filter("id % 10 < 2 and id % 7 > 0").select("path", F.when(F.col("id") % 10 == 0, "deleted").otherwise("changed").alias("state"))
    s = replies.status(g, drift)
    return spark.createDataFrame([(s["indexed_files"], s["changed"], s["fraction"], s["verdict"], s["usage_view"])], "indexed_files long, changed long, fraction double, verdict string, usage_view string")


@query(f"{_near(1)} SELECT symbol, display_name, file, line FROM site JOIN near USING (id) WHERE NOT {_TEST.format('file')}")
def export_nodes(spark, d):
    g, top = stored(spark, d)
    return replies.export(g, top, 1, exclude_tests=True)[0]


@query(f"{_near(1)} {_INSIDE} AND NOT {_TEST.format('a.file')} AND NOT {_TEST.format('b.file')}")
def export_edges(spark, d):
    g, top = stored(spark, d)
    return replies.export(g, top, 1, exclude_tests=True)[1].select("src", "dst", "file", "line")


@query(f"WITH {OCC}, span AS (SELECT doc, symbol AS container, enc_start AS s, enc_end AS e, doc_ord, occ_ord FROM occ WHERE symbol_roles & 1 <> 0 AND enc_start IS NOT NULL AND ({_FN} OR {_TY})), at_ AS (SELECT DISTINCT doc, line FROM occ) SELECT doc AS file, line, (SELECT arg_max(container, (s, doc_ord, occ_ord)) FROM span WHERE span.doc = at_.doc AND s <= line AND line <= e) AS symbol FROM at_")
def symbols_at_lines(spark, d):
    """The innermost body at each line that occurs, from a store that keeps bodies."""
    path = fresh_path(spark, "spans")
    o = cut(demo.occurrences(spark, d))
    i = cut(demo.symbol_info(spark, d, o))
    store.save(store.intern(derive.build(o, i, demo.relationships(spark, d, i), spans=True, keep=cut)), path)
    return locate.symbols_at(store.load(spark, path), o.select(F.col("doc").alias("file"), "line").distinct())


_LAYERS = [("src/economy", "economy", 1), ("src", "core", 2), ("vendor/", "vendor", 3), ("vendor/standard anodized brass", "brass", 0)]
_LAYER = "(SELECT arg_max((l, r), length(p)) FROM (VALUES " + ", ".join(f"('{p.rstrip('/')}', '{x}', {r})" for p, x, r in _LAYERS) + ") AS y(p, l, r) WHERE {0}.file = p OR starts_with({0}.file, p || '/'))"


@query(f"WITH {SYM}, {FIL}, {SITE}, {_calls()}, placed AS (SELECT id, symbol, {_LAYER.format('site')} AS x FROM site) SELECT a.symbol AS src, b.symbol AS dst, a.x[1] AS src_layer, b.x[1] AS dst_layer, f.path AS file, c.line FROM calls c JOIN placed a ON a.id = src_id JOIN placed b ON b.id = dst_id LEFT JOIN fil f ON f.id = c.file_id WHERE a.x[2] < b.x[2]")
def boundary_violations(spark, d):
    return layers.boundary_violations(stored(spark, d)[0], spark.createDataFrame(_LAYERS, "prefix string, layer string, rank int"))


@query(f"WITH RECURSIVE {TYPES}, {INH}, r(id, far) AS (SELECT id, id FROM typ UNION SELECT id, dst_id FROM r JOIN inh ON src_id = far) SELECT id, count(*)::BIGINT - 1 AS n, true AS is_exact FROM r GROUP BY id")
def dependency_cost(spark, d):
    """How many types each type derives from, directly or not: small sets, which are exact."""
    return layers.dependency_cost(types_graph(spark, d), "inherits")


INFO = "info AS (SELECT doc_ord, doc, min(occ_ord) AS sym_ord, symbol, CASE WHEN min(occ_ord) % 3 = 0 THEN '' ELSE 'n' || min(occ_ord) % 5 END AS display_name FROM occ GROUP BY doc_ord, doc, symbol)"
REL = "rel AS (SELECT doc, symbol AS src, CASE WHEN sym_ord % 4 < 3 THEN 'cxx . . $ ty/T' || sym_ord % 40 || '#' ELSE 'cxx . . $ fn/f' || sym_ord % 40 || '().' END AS dst FROM info WHERE sym_ord % 2 = 1)"
CALL = "call_ AS (SELECT DISTINCT src, dst, doc AS file, line FROM (SELECT * FROM inside UNION ALL SELECT * FROM before_) WHERE src IS NOT NULL)"
BUILT = f"""{OCC}, {SPANS}, {INSIDE}, {BEFORE}, {CALL}, {INFO}, {REL},
 edge AS (SELECT 'calls' AS kind, src, dst, file, line FROM call_ UNION ALL SELECT DISTINCT CASE WHEN ends_with(src, '#') AND ends_with(dst, '#') THEN 'inherits' ELSE 'implements' END, src, dst, doc, NULL::INT FROM rel),
 name_ AS (SELECT symbol, arg_min(display_name, (doc_ord, sym_ord)) FILTER (WHERE display_name <> '') AS display_name FROM info GROUP BY symbol),
 place AS (SELECT symbol, arg_min(doc, (doc_ord, occ_ord)) AS file, arg_min(line, (doc_ord, occ_ord)) AS line FROM occ WHERE symbol_roles & 1 <> 0 GROUP BY symbol),
 every_ AS (SELECT symbol FROM occ UNION SELECT src FROM edge UNION SELECT dst FROM edge),
 node AS (SELECT symbol, display_name, file, line FROM every_ LEFT JOIN name_ USING (symbol) LEFT JOIN place USING (symbol))"""


def _built(spark, d, **how) -> dict[str, DataFrame]:
    return derive.build(demo.occurrences(spark, d), demo.symbol_info(spark, d), demo.relationships(spark, d), **how)


@query(f"WITH {BUILT} SELECT * FROM node")
def build_nodes(spark, d):
    return _built(spark, d)["nodes"]


@query(f"WITH {BUILT} SELECT * FROM edge")
def build_edges(spark, d):
    return _built(spark, d)["edges"]


@query(f"WITH {BUILT} SELECT symbol, display_name FROM name_")
def build_names(spark, d):
    return derive.display_names(demo.symbol_info(spark, d))


@query(f"WITH {BUILT} SELECT (row_number() OVER (ORDER BY symbol))::BIGINT AS id, symbol FROM node")
def intern_symbols(spark, d):
    return store.intern(_built(spark, d)).symbols.select("id", "symbol")


@query(f"WITH {BUILT} SELECT kind, src, dst, file, line FROM edge")
def intern_edges(spark, d):
    """The edges of the interned graph by name again."""
    g = store.intern(_built(spark, d))
    s, f = g.symbols, g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    ends = g.edges.join(s.select(F.col("id").alias("src_id"), F.col("symbol").alias("src")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("symbol").alias("dst")), "dst_id")
    return ends.join(f, "file_id", "left").select("kind", "src", "dst", "file", "line")


def _indexed(spark, d) -> dict[str, DataFrame]:
    """Two index files, read back by a pattern."""
    at = fresh_path(spark, "index")
    every = {"occurrences": demo.occurrences(spark, d), "symbol_info": demo.symbol_info(spark, d), "relationships": demo.relationships(spark, d)}
    for k in (0, 1):
        scip.write_index({n: t.filter(F.col("doc_ord") % 2 == k) for n, t in every.items()}, f"{at}/{k}.scip")
    return scip.read_index(spark, f"{at}/*.scip")


@query(f"WITH {OCC} SELECT doc, symbol, symbol_roles, line, enc_start, enc_end, (row_number() OVER (PARTITION BY doc ORDER BY occ_ord) - 1)::BIGINT AS occ_ord FROM occ")
def index_occurrences(spark, d):
    return _indexed(spark, d)["occurrences"].drop("doc_ord")


@query(f"WITH {OCC}, {SPANS}, {INSIDE}, {BEFORE}, {CALL} SELECT 'calls' AS kind, * FROM call_")
def index_build_calls(spark, d):
    """From index files to call edges."""
    got = _indexed(spark, d)
    return derive.build(got["occurrences"], got["symbol_info"], got["relationships"])["edges"].filter("kind = 'calls'")


@query(f"WITH {OCC} SELECT doc, symbol, symbol_roles, line, enc_start, enc_end, (row_number() OVER (PARTITION BY doc ORDER BY occ_ord) - 1)::BIGINT AS occ_ord FROM occ")
def index_source(spark, d):
    """The same by the registered source, in ranges of 64 KB."""
    at = fresh_path(spark, "index")
    scip.write_index({"occurrences": demo.occurrences(spark, d), "symbol_info": demo.symbol_info(spark, d), "relationships": demo.relationships(spark, d)}, f"{at}/0.scip")
    scip.register(spark)
    return spark.read.format("scip").option("range", 1 << 16).load(f"{at}/*.scip").drop("doc_ord")


@query("SELECT 'index' AS what, true AS exists, count(DISTINCT user_id)::BIGINT AS documents, false AS failed FROM events UNION ALL SELECT 'other', true, NULL, true UNION ALL SELECT 'missing', false, NULL, false")
def index_head(spark, d):
    """What is said of an index, of a file that is none, and of no file."""
    at = fresh_path(spark, "index")
    o = demo.occurrences(spark, d)
    scip.write_index({"occurrences": o, "symbol_info": demo.symbol_info(spark, d), "relationships": demo.relationships(spark, d)}, f"{at}/index")
    raw.write_file(o.select("doc").distinct(), f"{at}/other", "\n")
    said = {what: scip.describe(spark, f"{at}/{what}") for what in ("index", "other", "missing")}
    rows = [(what, s["exists"], None if "error" in s else s.get("documents"), "error" in s) for what, s in said.items()]
    return spark.createDataFrame(rows, "what string, exists boolean, documents long, failed boolean")


@query(f"WITH {BUILT}, u AS (SELECT DISTINCT symbol, doc, line FROM occ WHERE symbol_roles & 65 = 0), w AS (SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM occ s WHERE s.symbol_roles & 1 <> 0 AND s.enc_start IS NOT NULL AND ({_FN} OR {_TY}) AND s.doc = u.doc AND s.enc_start <= u.line AND u.line <= s.enc_end))::BIGINT AS attributed FROM u), n AS (SELECT (SELECT count(*)::BIGINT FROM edge) AS edges, (SELECT count(*)::BIGINT FROM u) AS refs) SELECT include_references, attribute_references, edges, CASE WHEN include_references THEN refs ELSE 0 END AS refs, CASE WHEN include_references AND attribute_references THEN attributed ELSE 0 END AS attributed FROM n, w, (VALUES (false, false), (false, true), (true, false), (true, true)) AS f(include_references, attribute_references)")
def build_flags(spark, d):
    """What a build holds by its flags; attribution alone changes nothing."""
    out = []
    for refs in (False, True):
        for attributed in (False, True):
            got = _built(spark, d, include_references=refs, attribute_references=attributed)
            counted = got["refs"].agg(F.count(F.lit(1)).alias("refs"), F.count("enclosing").alias("attributed"))
            out.append(got["edges"].agg(F.count(F.lit(1)).alias("edges")).crossJoin(counted).select(F.lit(refs).alias("include_references"), F.lit(attributed).alias("attribute_references"), "edges", "refs", "attributed"))  # one row each
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {OCC}, {INFO}, {REL} SELECT doc, src, dst FROM rel")
def index_relationships(spark, d):
    return _indexed(spark, d)["relationships"].filter("is_implementation").select("doc", "src", "dst")


_NEW = "'cxx . . $ new/n' || id % 7 || '(' || id || ').'"


@query(f"WITH {SYM}, {FIL}, {SITE}, fresh AS (SELECT symbol, display_name || '!' AS name, 'src/new/x' || id % 9 || '.cpp' AS file, 7 AS line FROM sym WHERE id % 50 = 0 UNION ALL SELECT {_NEW}, 'new', 'src/new/y.cpp', (id % 100)::INT FROM sym WHERE id % 40 = 0 UNION ALL SELECT symbol, '', NULL, NULL FROM sym WHERE id % 50 = 1) SELECT symbol, coalesce(nullif(fresh.name, ''), site.display_name) AS display_name, coalesce(fresh.file, site.file) AS file, coalesce(fresh.line, site.line) AS line FROM site FULL JOIN fresh USING (symbol)")
def update_symbols(spark, d):
    """New symbols, names and sites, in files that the store didn't know; an empty name and a missing site change nothing."""
    return _updated(spark, d)[0]


def _updated(spark, d):
    g, _ = stored(spark, d)
    s, f = g.symbols, F.col
    one = s.filter("id % 50 = 0").select("symbol", F.concat("display_name", F.lit("!")).alias("display_name"), F.concat(F.lit("src/new/x"), (f("id") % 9).cast("string"), F.lit(".cpp")).alias("file"), F.lit(7).alias("line"))
    two = s.filter("id % 40 = 0").select(F.concat(F.lit("cxx . . $ new/n"), (f("id") % 7).cast("string"), F.lit("("), f("id").cast("string"), F.lit(").")).alias("symbol"), F.lit("new").alias("display_name"), F.lit("src/new/y.cpp").alias("file"), (f("id") % 100).cast("int").alias("line"))
    three = s.filter("id % 50 = 1").select("symbol", F.lit("").alias("display_name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    edges = two.select(F.lit("calls").alias("kind"), f("symbol").alias("src"), f("symbol").alias("dst"), "file", "line")
    none = spark.createDataFrame([], "symbol string, file string, line int, enclosing string")
    docs = one.select(f("file").alias("doc")).union(two.select("file")).distinct()
    out, stats = updated(spark, d, {"nodes": one.union(two).union(three), "edges": edges, "refs": none}, docs)
    files = out.files.select(f("id").alias("file_id"), f("path").alias("file"))
    return out.symbols.join(files, "file_id", "left").select("symbol", "display_name", "file", "line"), stats


@query(f"WITH {SYM}, {_calls()}, new AS (SELECT count(*) AS n FROM sym WHERE id % 40 = 0), doc AS (SELECT count(DISTINCT id % 9) + 1 AS n FROM sym WHERE id % 50 = 0) SELECT (SELECT n FROM doc)::BIGINT AS files_changed, 0::BIGINT AS edges_removed, (SELECT n FROM new)::BIGINT AS edges_added, 0::BIGINT AS symbols_removed, ((SELECT count(*) FROM sym) + (SELECT n FROM new))::BIGINT AS node_count, ((SELECT count(*) FROM calls) + (SELECT n FROM new))::BIGINT AS edge_count")
def update_stats(spark, d):
    stats = vars(_updated(spark, d)[1])
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} long" for k in stats))


@query(f"WITH {FIL}, diff AS (SELECT path, CASE WHEN id % 10 = 0 THEN 'deleted' ELSE 'changed' END AS state FROM fil WHERE id % 5 = 0), fp AS (SELECT path, (id % 4)::VARCHAR AS was FROM fil WHERE id % 3 = 0), now_ AS (SELECT path, (id % 8)::VARCHAR AS is_ FROM fil WHERE id % 4 > 0) SELECT path, state FROM (SELECT path, CASE WHEN state = 'deleted' THEN 'deleted' WHEN was IS NULL THEN state WHEN was IS NOT DISTINCT FROM is_ THEN NULL WHEN is_ IS NOT NULL THEN 'changed' ELSE state END AS state FROM diff FULL JOIN fp USING (path) LEFT JOIN now_ USING (path)) WHERE state IS NOT NULL")
def dirty_fingerprints(spark, d):
    f = demo.files(spark, d)
    diff = f.filter("id % 5 = 0").select("path", F.when(F.col("id") % 10 == 0, "deleted").otherwise("changed").alias("state"))
    was = f.filter("id % 3 = 0").select("path", (F.col("id") % 4).cast("string").alias("hash"))
    now = f.filter("id % 4 > 0").select("path", (F.col("id") % 8).cast("string").alias("hash"))
    return freshness.correct_changes(diff, was, now)


@query(f"WITH {BUILT} SELECT * FROM edge")
def stream_edges(spark, d):
    """The edges of a store that followed streams of the index's tables, over an empty store: calls, and inherits and implements."""
    return _streamed(spark, d)[0]


@query(f"WITH {BUILT} SELECT * FROM node")
def stream_nodes(spark, d):
    """Its symbols, with names and sites."""
    return _streamed(spark, d)[1]


_FOLLOWED: dict[tuple[str, str], str] = {}


def _followed(spark, d) -> str:
    """A store after two runs of the stream, made once for each application and folder of tables: occurrences and documents
    first, then the other tables and a later revision that ends the first."""
    key = (spark.sparkContext.applicationId, d)
    if key in _FOLLOWED:
        return _FOLLOWED[key]
    at = fresh_path(spark, "stream")
    o = demo.occurrences(spark, d)
    tables = {"occurrences": o, "symbol_info": demo.symbol_info(spark, d), "relationships": demo.relationships(spark, d), "documents": o.select("doc_ord", "doc").distinct()}
    empty = {k: spark.createDataFrame([], f"{s}, revision timestamp") for k, s in updates.TABLES.items()}
    stamp = F.timestamp_seconds(F.lit(86_400)).alias("revision")
    none = {"nodes": "symbol string, display_name string, file string, line int", "edges": "kind string, src string, dst string, file string, line int", "refs": "symbol string, file string, line int, enclosing string"}
    store.save(store.intern({k: spark.createDataFrame([], s) for k, s in none.items()}), f"{at}/store")
    for names in (("occurrences", "documents"), ("symbol_info", "relationships")):
        for k, df in empty.items():
            rows = tables[k].select(*(c.split()[0] for c in updates.TABLES[k].split(", ")), stamp) if k in names else df
            if k == "documents" and k not in names:  # something later, which ends the revision
                rows = spark.createDataFrame([(-1, "src/later.cpp")], schema.DOCUMENTS).select("doc_ord", "doc", F.timestamp_seconds(F.lit(90_000)).alias("revision"))
            rows.write.mode("append").parquet(f"{at}/in/{k}")
        updates.follow(spark, f"{at}/in", f"{at}/store", f"{at}/checkpoint").awaitTermination()
    _FOLLOWED[key] = f"{at}/store"
    return _FOLLOWED[key]


def _streamed(spark, d) -> tuple[DataFrame, DataFrame]:
    g = store.load(spark, _followed(spark, d))
    s, f = g.symbols, g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    edges = g.edges.join(s.select(F.col("id").alias("src_id"), F.col("symbol").alias("src")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("symbol").alias("dst")), "dst_id")
    return edges.join(f, "file_id", "left").select("kind", "src", "dst", "file", "line"), g.sites().select("symbol", "display_name", "file", "line")


def _entries(spark, d) -> DataFrame:
    """A compilation database of the demo's files, written and read back."""
    path = f"{fresh_path(spark, 'compdb')}/compile_commands.json"
    compdb.write_compdb(demo.files(spark, d).select(F.lit("/build").alias("directory"), F.concat(F.lit("/repo/"), F.col("path")).alias("file"), F.concat(F.lit("cc -c "), F.col("path")).alias("command")), path)
    return compdb.load_compdb(spark, path)


@query(f"WITH {FIL} SELECT '/build' AS directory, '/repo/' || path AS file, 'cc -c ' || path AS command FROM fil")
def compdb_round_trip(spark, d):
    return _entries(spark, d).select("directory", "file", "command")


@query(f"WITH {FIL}, f AS (SELECT path, {_TEST.format('path')} AS test FROM fil) SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE test)::BIGINT AS tests, '/repo' AS common_prefix, count(*) FILTER (WHERE path LIKE '%economy%')::BIGINT AS matched, count(*) FILTER (WHERE path LIKE '%economy%' AND test)::BIGINT AS matched_tests, round(100.0 * count(*) FILTER (WHERE test) / count(*))::BIGINT AS percent FROM f")
def compdb_summary(spark, d):
    s = compdb.summarize(_entries(spark, d), "economy")
    return spark.createDataFrame([(s["total"], s["tests"], s["common_prefix"], s["matched"], s["matched_tests"], round(100 * s["tests"] / s["total"]))], "total long, tests long, common_prefix string, matched long, matched_tests long, percent long")


@query(f"WITH {FIL} SELECT '/repo/' || path AS file FROM fil WHERE path LIKE '%economy%' AND NOT {_TEST.format('path')}")
def compdb_filter(spark, d):
    return compdb.filter_compdb(_entries(spark, d), "economy", no_tests=True)[0].select("file")


@query(f"WITH {FIL} SELECT '/repo/' || path AS file FROM fil WHERE EXISTS (SELECT 1 FROM (SELECT path AS p FROM fil WHERE id % 400 = 0) WHERE contains(path, p))")
def compdb_changed(spark, d):
    f = demo.files(spark, d)
    return compdb.changed_units(f.select(F.concat(F.lit("/repo/"), F.col("path")).alias("file")), f.filter("id % 400 = 0").select("path")).select("file")


@query(f"WITH {FIL}, v AS (SELECT unnest([path, upper(path), path || '.h', path || '.txt', replace(path, '.cpp', '.cuh')]) AS path FROM fil) SELECT DISTINCT path, regexp_matches(lower(path), '\\.(cpp|cc|cxx|c|cu|h|hpp|hh|hxx|ipp|inl|cuh)$') AS is_source FROM v")
def source_files(spark, d):
    p = F.col("path")
    f = demo.files(spark, d).select(F.explode(F.array(p, F.upper(p), F.concat(p, F.lit(".h")), F.concat(p, F.lit(".txt")), F.replace(p, F.lit(".cpp"), F.lit(".cuh")))).alias("path")).distinct()
    return f.select("path", paths.is_source_file(p).alias("is_source"))


@query(f"WITH {SYM}, {TYPES}, s AS (SELECT symbol, display_name, line FROM sym UNION ALL SELECT symbol || '  ', NULL, NULL FROM typ) SELECT symbol, regexp_matches(symbol, '# *$') AS type_query, coalesce(nullif(display_name, ''), {_label('symbol')}) AS label, line + 1 AS line1, 'L' || (line + 1) AS location FROM s")
def display_labels(spark, d):
    s = demo.symbols(spark, d).select("symbol", "display_name", "line").unionByName(demo.types(spark, d).select(F.concat("symbol", F.lit("  ")).alias("symbol"), "display_name", "line"))
    c, line = F.col("symbol"), F.col("line")
    return s.select("symbol", symbols.is_type_query(c).alias("type_query"), symbols.display_label(c, F.col("display_name")).alias("label"), symbols.line1(line).alias("line1"), symbols.location(line).alias("location"))


@query("SELECT DISTINCT v AS version, array_to_string(list_transform(string_split(regexp_extract(v, '^v?([0-9]+(\\.[0-9]+)*)', 1), '.'), lambda x: x::INT), ',') AS parsed FROM (SELECT unnest(['v1.' || p_size, p_size || '.0.' || p_partkey % 9, '0.' || p_size || '.2-rc1', 'v2.' || p_size || '.x.7']) AS v FROM part)")
def parsed_versions(spark, d):
    n, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")
    v = demo.table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("v1."), n), F.concat(n, F.lit(".0."), k), F.concat(F.lit("0."), n, F.lit(".2-rc1")), F.concat(F.lit("v2."), n, F.lit(".x.7")))).alias("version")).distinct()
    return v.select("version", F.array_join(F.transform(versions.parse_version(F.col("version")), lambda x: x.cast("string")), ",").alias("parsed"))


@query("WITH v AS (SELECT p_size AS n, max(CASE p_size % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END) AS lev FROM part GROUP BY p_size) SELECT '1.20' AS current, '1.' || max(n) AS latest, max(n) > 20 AS update_available, CASE coalesce(max(lev) FILTER (WHERE n > 10 AND n <= 20), 0) WHEN 2 THEN 'reindex' WHEN 1 THEN 'store' ELSE 'none' END AS rebuild_now, CASE coalesce(max(lev) FILTER (WHERE n > 10), 0) WHEN 2 THEN 'reindex' WHEN 1 THEN 'store' ELSE 'none' END AS rebuild_after_update FROM v")
def update_advice(spark, d):
    """Advice from a table of releases, for version 1.20 and a store that 1.10 made."""
    level = F.get(F.array(*map(F.lit, versions.LEVELS)), (F.col("p_size") % 3).cast("int"))
    releases = demo.table(spark, d, "part").select(F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), level.alias("level"))
    return versions.advise(releases, "1.20", built_with="1.10")


def _sources(spark, d) -> tuple[DataFrame, DataFrame]:
    """The lines of a source tree, written and read back: a file for every hundred parts, two lines for each part, in order
    of the parts. And the parts with their places in it (file, line, p_size)."""
    root = fresh_path(spark, "sources")
    unit = F.floor(F.col("p_partkey") / 100)
    p = demo.table(spark, d, "part").select(unit.alias("unit"), "p_partkey", "p_size")
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("int f"), key, F.lit("(long x"), key, F.lit(",\n   int y) { return "), key, F.lit("; }"))
    rows = p.repartition("unit").sortWithinPartitions("unit", "p_partkey").select("unit", text.alias("text"))
    rows.write.partitionBy("unit").text(root)
    unit_of = F.concat(F.lit("u"), F.regexp_extract("file", "^unit=([^/]*)/", 1), F.lit(".cpp"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("p_partkey"))
    sites = p.select(F.concat(F.lit("u"), F.col("unit").cast("string"), F.lit(".cpp")).alias("file"), (2 * place - 2).cast("int").alias("line"), "p_size")
    return snippets.tree_lines(spark, root).withColumn("file", unit_of), sites


TREE = "tree AS (SELECT 'u' || p_partkey // 100 || '.cpp' AS file, p_partkey AS k, p_size, (2 * row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 2)::INT AS line FROM part)"


@query(f"WITH {TREE}, l AS (SELECT file, line + o AS line, CASE o WHEN 0 THEN 'int f' || k || '(long x' || k || ',' ELSE '   int y) {{ return ' || k || '; }}' END AS text, p_size > 40 AND o = 0 AS is_use FROM tree, (SELECT unnest([0, 1]) AS o)) SELECT file, (line + 1)::INT AS line1, text, is_use FROM l WHERE EXISTS (SELECT 1 FROM l u WHERE u.is_use AND u.file = l.file AND abs(u.line - l.line) <= 3)")
def source_windows(spark, d):
    """The source around the definitions of large parts."""
    lines, sites = _sources(spark, d)
    return snippets.merged_source(lines, sites.filter("p_size > 40"), 3)


@query(f"WITH {TREE} SELECT file, line, '(long x' || k || ', int y)' AS signature FROM tree")
def source_signatures(spark, d):
    return snippets.signatures(*_sources(spark, d)).select("file", "line", "signature")


def _saved(spark, d) -> dict[str, DataFrame]:
    """The types and their derivation, saved as JSON and loaded."""
    g, path = types_graph(spark, d), fresh_path(spark, "json")
    s = g.symbols.select("id", "symbol")
    edges = g.edges.join(s.select(F.col("id").alias("src_id"), F.col("symbol").alias("src")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("symbol").alias("dst")), "dst_id")
    graphjson.save_json(g.sites().drop("id"), edges.select("kind", "src", "dst", F.lit(None).cast("string").alias("file"), "line"), path)
    return graphjson.load_json(spark, path)


@query(f"WITH {TYPES} SELECT symbol, NULL::VARCHAR AS display_name, NULL::VARCHAR AS file, NULL::INT AS line FROM typ")
def json_nodes(spark, d):
    return _saved(spark, d)["nodes"]


@query(f"WITH {TYPES}, {INH} SELECT 'inherits' AS kind, a.symbol AS src, b.symbol AS dst, NULL::VARCHAR AS file, NULL::INT AS line FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id")
def json_edges(spark, d):
    return _saved(spark, d)["edges"]


@query(f"WITH {TYPES}, {INH} SELECT a.symbol AS source, b.symbol AS target, 'inherits' AS relation, (SELECT count(*)::INT FROM inh WHERE dst_id = (SELECT id FROM typ WHERE symbol = '{TYPE}')) + 1 AS nodes FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE b.symbol = '{TYPE}'")
def export_json(spark, d):
    """The links of the node-link form of a neighbourhood."""
    out = graphjson.node_link(*replies.export(types_graph(spark, d), TYPE, 1))
    got = out.select(F.from_json("json", "nodes array<struct<id string>>, links array<struct<source string, target string, relation string>>").alias("j"))
    return got.select(F.size("j.nodes").alias("nodes"), F.explode("j.links").alias("l")).select("l.*", "nodes")


@query(f"WITH {TYPES}, {INH}, near AS (SELECT id FROM typ WHERE symbol = '{TYPE}' UNION SELECT src_id FROM inh WHERE dst_id = (SELECT id FROM typ WHERE symbol = '{TYPE}')) SELECT 'inherits' AS kind, a.symbol AS src, b.symbol AS dst FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE src_id IN (SELECT id FROM near) AND dst_id IN (SELECT id FROM near)")
def node_link_edges(spark, d):
    """A neighbourhood exported in the node-link form, written and loaded."""
    path = fresh_path(spark, "links")
    graphjson.node_link(*replies.export(types_graph(spark, d), TYPE, 1)).select("json").write.text(path)
    return graphjson.load_node_link(spark, path)["edges"].select("kind", "src", "dst")


@query(f"WITH {FIL} SELECT '/repo/' || path AS path FROM fil")
def project_paths(spark, d):
    return demo.files(spark, d).select(paths.project_root_path(F.concat(F.lit("file:///repo/"), F.col("path"))).alias("path"))


@query(f"WITH {FIL} SELECT count(*)::BIGINT AS files, 'v2' AS version FROM fil")
def store_reload(spark, d):
    """A store that moves on is read anew, and its files are counted."""
    path = fresh_path(spark, "moving")
    files = demo.files(spark, d)
    held = CodeGraph(files.limit(0), demo.symbols(spark, d).limit(0), demo.inherits(spark, d).limit(0))
    store.save(held, path, {"index_tool": "v1"})
    live = store.ReloadingStore(spark, path)
    before = live.get()
    store.save(CodeGraph(files, held.symbols, held.edges), path, {"index_tool": "v2"})
    after = live.get()
    known = "stale" if before is after else after.meta["index_tool"]
    return spark.createDataFrame([(store.indexed_file_count(after), known)], "files long, version string")


@query(f"WITH {TYPES} SELECT count(*)::BIGINT AS nodes, (SELECT count(*) FROM customer)::BIGINT + (SELECT count(*) FROM nation) AS edges, true AS found, true AS nothing_else FROM typ")
def store_discovery(spark, d):
    """A store is found from a folder below its own, and none where there is none."""
    at = fresh_path(spark, "project")
    g = types_graph(spark, d)
    store.save(CodeGraph(g.files.limit(0), g.symbols, g.edges), f"{at}/.stellate/types", {"index_tool": "tables"})
    store._write_text(spark, f"{at}/src/deep/a.cpp", "")
    found = store.discover(f"{at}/src/deep")
    live = store.load(spark, found)
    none = store.discover(fresh_path(spark, "elsewhere"))
    counted = live.edges.agg(F.count(F.lit(1)).alias("edges"))
    return live.symbols.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(counted).select("nodes", "edges", F.lit(found.endswith("/.stellate/types")).alias("found"), F.lit(none is None).alias("nothing_else"))  # one row each


@query(f"WITH {FIL} SELECT true AS found, count(*)::BIGINT AS entries FROM fil")
def compdb_discovery(spark, d):
    """A compilation database in the build folder of a project is found from below."""
    at = fresh_path(spark, "project")
    compdb.write_compdb(demo.files(spark, d).select(F.concat(F.lit("/repo/"), F.col("path")).alias("file")), f"{at}/build/compile_commands.json")
    store._write_text(spark, f"{at}/src/deep/a.cpp", "")
    found = compdb.find_compdb(f"{at}/src/deep")
    return compdb.load_compdb(spark, found).agg(F.lit(found.endswith("/build/compile_commands.json")).alias("found"), F.count(F.lit(1)).alias("entries"))


def _said(spark, d, *argv: str) -> DataFrame:
    """What a command prints about the stored graph, a row for each result."""
    from stellate import __main__ as command_line

    text = command_line.main([argv[0], store_of(spark, d)[0], *argv[1:]], spark)
    row = "struct<total:bigint,truncated:boolean,results:array<struct<key:string,symbol:string,file:string,line:int,n:bigint,used_by:string>>>"
    return flat(spark.createDataFrame([(text,)], "said string").select(F.from_json("said", row).alias("r")).select("r.*"), "total", "truncated")


@query(f"{CALLED}, x AS (SELECT symbol AS key, coalesce(nullif(display_name, ''), {_label('symbol')}) AS symbol, file, line + 1 AS line, n FROM (SELECT dst_id AS id, count(*)::BIGINT AS n FROM calls GROUP BY dst_id) JOIN site USING (id)) {_shown('n DESC, key', 'x', 'key, symbol, file, line, n', 20)}")
def command_hotspots(spark, d):
    """The command shows 20."""
    return _said(spark, d, "hotspots", "--tests", "include").drop("used_by")


@query(f"{CALLED}, {REFS}, x AS (SELECT f.path AS file, r.line + 1 AS line FROM refs r LEFT JOIN fil f ON f.id = r.file_id WHERE r.symbol_id = (SELECT id FROM hub) AND NOT {_TEST.format('f.path')}) {_shown('file, line', 'x', 'file, line', 50)}")
def command_references(spark, d):
    """The command shows 50."""
    return _said(spark, d, "references", store_of(spark, d)[1]).select("total", "truncated", "place", "file", "line")


@query(f"WITH {TYPES}, {INH} SELECT a.symbol AS source, b.symbol AS target, 'inherits' AS relation FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE b.symbol = '{TYPE}'")
def viewer_links(spark, d):
    """The links in the page that draws a neighbourhood."""
    found = graphjson.node_link(*replies.export(types_graph(spark, d), TYPE, 1)).first()["json"]
    page = spark.createDataFrame([(graphjson.viewer_html(found, TYPE),)], "page string")
    links = F.from_json(graphjson.viewer_graph(F.col("page")), "links array<struct<source string, target string, relation string>>")["links"]
    return page.select(F.explode(links).alias("l")).select("l.*")
