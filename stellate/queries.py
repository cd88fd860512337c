"""The catalogue of graph queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions import paths, symbols, versions
from stellate.operators import derive, freshness, store
from stellate.plans import components, replies, traverse
from stellate.plans.graph import CodeGraph
from stellate.session import fresh_path
from stellate.sources import compdb, demo, scip, snippets

INCLUDE, EXCLUDE = ["src/economy", "src/standard"], ["vendor/", "src/promo"]
TYPE = "cxx . . $ region/ASIA#"


def calls_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Parts that call each other; each use of a type-like event is a reference to the part of its number."""
    refs = demo.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol_id"), (F.col("l_orderkey") + demo.UNIT_BASE).alias("file_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("enclosing_id")).distinct()
    return CodeGraph(demo.files(spark, sf_dir), demo.symbols(spark, sf_dir), demo.calls(spark, sf_dir), refs)


def types_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph(demo.files(spark, sf_dir), demo.types(spark, sf_dir), demo.inherits(spark, sf_dir))


_STORES: dict[tuple[str, str], tuple[str, str]] = {}
_NAMED: set[tuple[str, str]] = set()  # stores with an index of names


def store_of(spark: SparkSession, sf_dir: str, names: bool = True) -> tuple[str, str]:
    """(path of a store of calls_graph, most called symbol), made once for each application and folder of tables; its index of
    names when it is first asked for with names."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = fresh_path(spark, "store")
        store.save(calls_graph(spark, sf_dir), path, store.provenance(project_root="/demo", tool="tables", commit="c0ffee"))
        _STORES[key] = path, hub(store.load(spark, path))
    if names and key not in _NAMED:
        store.index_names(spark, _STORES[key][0])
        _NAMED.add(key)
    return _STORES[key]


def _base(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(path, version) of the store of store_of."""
    path, _ = store_of(spark, sf_dir)
    return path, store.current_version(spark, path)


def updated(spark: SparkSession, sf_dir: str, built: dict[str, DataFrame], documents: DataFrame, deleted: DataFrame | None = None) -> tuple[CodeGraph, store.UpdateStats]:
    """The stored graph after an update on top of it, reopened; the store's current version stays."""
    path, onto = _base(spark, sf_dir)
    version, stats = store.stage(spark, path, onto, built, documents, deleted)
    return store.load(spark, path, version), stats


def stored(spark: SparkSession, sf_dir: str, by: str = "dst", names: bool = True) -> tuple[CodeGraph, str]:
    """The stored graph, edges sorted by one end, and its most called symbol. Without names it may lack their index."""
    path, top = store_of(spark, sf_dir, names)
    return store.load(spark, path, by=by), top


def hub(graph: CodeGraph) -> str:
    """The most called symbol; of equal ones the least id."""
    top = graph.degrees("fan_in").orderBy(F.desc("n"), "id").limit(1)
    return top.join(graph.symbols.select("id", "symbol"), "id").first()["symbol"]


SYM = "sym AS (SELECT p_partkey AS id, 'cxx . . $ ' || lower(p_type) || '/' || replace(p_brand, '#', '') || '#' || replace(p_name, ' ', '_') || '(' || lpad(p_partkey::VARCHAR, 8, '0') || ').' AS symbol, p_name AS display_name, p_partkey AS file_id, p_size AS line FROM part)"
_TEST = "coalesce(lower(replace({0}, '\\', '/')) LIKE '%/test/%' OR lower(replace({0}, '\\', '/')) LIKE '%/tests/%' OR regexp_matches(lower(replace({0}, '\\', '/')), '(^|/)test_[^/]*$|(^|/)[^/]*(_test|_tests|_unittest)(\\.[^./]*)?$|(^|/)[^/]*_test_[^/]*\\.[^./]*$|(^|/)[^/.]*_test_[^/.]*$'), false)"
FIL = "fil AS (SELECT p_partkey AS id, (CASE WHEN p_size % 5 = 0 THEN 'vendor/' ELSE 'src/' END) || lower(p_type) || '/' || replace(p_name, ' ', '_') || (CASE WHEN p_size % 7 = 0 THEN '_test.cpp' ELSE '.cpp' END) AS path FROM part UNION ALL SELECT o_orderkey + 1000000000, 'src/unit/o' || o_orderkey || '.cpp' FROM orders)"


def _calls() -> str:
    return "calls AS (SELECT DISTINCT a.l_partkey AS src_id, b.l_partkey AS dst_id, a.l_orderkey + 1000000000 AS file_id, a.l_linenumber AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


SITE = "site AS (SELECT sym.id, symbol, display_name, path AS file, line FROM sym LEFT JOIN fil ON fil.id = sym.file_id)"
HUB = "hub AS (SELECT dst_id AS id FROM calls GROUP BY dst_id ORDER BY count(*) DESC, dst_id LIMIT 1)"
REFS = "refs AS (SELECT DISTINCT l_partkey AS symbol_id, l_orderkey + 1000000000 AS file_id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS enclosing_id FROM lineitem)"
TYPES = "typ AS (SELECT c_custkey AS id, 'cxx . . $ cust/C' || c_custkey || '#' AS symbol FROM customer UNION ALL SELECT n_nationkey + 1000000000, 'cxx . . $ nation/' || n_name || '#' FROM nation UNION ALL SELECT r_regionkey + 2000000000, 'cxx . . $ region/' || r_name || '#' FROM region)"
INH = "inh AS (SELECT c_custkey AS src_id, c_nationkey + 1000000000 AS dst_id FROM customer UNION ALL SELECT n_nationkey + 1000000000, n_regionkey + 2000000000 FROM nation)"
OCC = """occ AS (SELECT doc_ord, doc, occ_ord, CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'cxx . . $ fn/f' || k % 40 || '().' ELSE 'cxx . . $ ty/T' || k % 40 || '#' END AS symbol,
 CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 64 ELSE 0 END AS symbol_roles, line, CASE WHEN event_type = 'signup' AND k % 3 > 0 THEN line END AS enc_start, CASE WHEN event_type = 'signup' AND k % 3 > 0 THEN line + k % 20 END AS enc_end
 FROM (SELECT user_id AS doc_ord, 'src/u' || user_id || '.cpp' AS doc, event_id AS occ_ord, event_type, regexp_extract(props, '([0-9]+)', 1)::INT AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS line FROM events))"""
_FN, _TY = "ends_with(symbol, ').')", "ends_with(symbol, '#')"
SPANS = f"span AS (SELECT doc, symbol AS container, enc_start AS s, enc_end AS e, doc_ord, occ_ord FROM occ WHERE symbol_roles & 1 <> 0 AND enc_start IS NOT NULL AND {_FN})"
INSIDE = f"use_ AS (SELECT DISTINCT doc, line, symbol AS dst FROM occ WHERE symbol_roles & 65 = 0 AND {_FN}), inside AS (SELECT u.doc, u.line, u.dst, (SELECT arg_max(container, (s, doc_ord, occ_ord)) FROM span WHERE span.doc = u.doc AND s <= u.line AND u.line <= e) AS src FROM use_ u WHERE doc IN (SELECT doc FROM span))"
BEFORE = f"def_ AS (SELECT doc, line, max(symbol) AS name FROM occ WHERE symbol_roles & 1 <> 0 AND {_FN} GROUP BY doc, line), before_ AS (SELECT u.doc, u.line, u.dst, (SELECT arg_max(name, line) FROM def_ WHERE def_.doc = u.doc AND def_.line <= u.line) AS src FROM use_ u WHERE doc NOT IN (SELECT doc FROM span))"


def _label(x: str) -> str:
    tail = f"(CASE WHEN strpos({x}, ' $ ') > 0 THEN substr({x}, strpos({x}, ' $ ') + 3) ELSE {x} END)"
    return f"replace(regexp_replace(regexp_replace({tail}, '`\\$anonymous_namespace_[^`]*`/', '', 'g'), '\\([0-9a-f]{{6,}}\\)', '', 'g'), '`', '')"


def _qualified(x: str) -> str:
    return f"regexp_replace(split_part({_label(x)}, '(', 1), '\\.+$', '')"


def _leaf(x: str) -> str:
    return f"regexp_extract({_qualified(x)}, '([^#/]*)$', 1)"


def _trivial(x: str) -> str:
    return f"({_leaf(x)} IN ({', '.join(repr(t) for t in symbols.TRIVIAL_LEAVES)}) OR {' OR '.join(f'contains({_label(x)}, {p!r})' for p in symbols.TRIVIAL_PARTS)})"


def _under(x: str, prefixes: list[str]) -> str:
    cleaned = [p.rstrip("/") for p in prefixes]
    return "(" + " OR ".join(f"{x} = '{p}' OR starts_with({x}, '{p}/')" for p in cleaned) + ")"


def _reach(near: str, far: str, pairs: str, start: str, depth: int | None = None) -> str:
    """SQL for (id, depth) of all that reaches `start`; without a depth plain reachability."""
    if depth is None:
        return f"r(id) AS (SELECT id FROM {start} UNION SELECT {far} FROM r JOIN {pairs} ON {near} = r.id)"
    return f"r(id, depth) AS (SELECT id, 0 FROM {start} UNION SELECT {far}, depth + 1 FROM r JOIN {pairs} ON {near} = r.id WHERE depth < {depth})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SYM} SELECT * FROM sym")
def symbols_scan(spark, d):
    return demo.symbols(spark, d)


@query(f"WITH {FIL} SELECT id, path, {_TEST.format('path')} AS is_test FROM fil")
def files_scan(spark, d):
    return demo.files(spark, d)


@query(f"WITH {_calls()} SELECT 'calls' AS kind, * FROM calls")
def edges_calls(spark, d):
    return demo.calls(spark, d)


@query(f"WITH {INH} SELECT 'inherits' AS kind, src_id, dst_id FROM inh")
def edges_inherits(spark, d):
    return demo.inherits(spark, d).select("kind", "src_id", "dst_id")


@query("SELECT DISTINCT 'implements' AS kind, l_suppkey AS src_id, l_partkey AS dst_id FROM lineitem")
def edges_implements(spark, d):
    return demo.implements(spark, d).select("kind", "src_id", "dst_id")


@query(f"WITH {OCC} SELECT * FROM occ")
def occurrences(spark, d):
    return demo.occurrences(spark, d)


@query(f"WITH {SYM}, {FIL}, {SITE}, {_calls()}, {HUB} SELECT symbol, coalesce(display_name, '') AS display_name, file, line FROM site WHERE id = (SELECT id FROM hub)")
def get_node(spark, d):
    g, top = stored(spark, d)
    return g.get_node(top)


@query(f"WITH {SYM}, {FIL}, {SITE} SELECT symbol, display_name, file, line FROM site WHERE strpos(symbol, 'widget') > 0 OR strpos(display_name, 'widget') > 0")
def find_token(spark, d):
    return stored(spark, d)[0].find("widget")


@query(f"WITH {SYM}, {FIL}, {SITE} SELECT symbol, display_name, file, line FROM site WHERE (strpos(symbol, 'gear') > 0 OR strpos(display_name, 'gear') > 0) AND (strpos(symbol, 'Brand') > 0 OR strpos(display_name, 'Brand') > 0)")
def find_multi_token(spark, d):
    return stored(spark, d)[0].find("Brand gear")


@query(f"WITH {SYM}, {FIL}, {SITE} SELECT symbol, display_name, file, line FROM site WHERE strpos(replace(lower(symbol), '_', ''), 'brand2') > 0 OR strpos(replace(lower(display_name), '_', ''), 'brand2') > 0")
def find_fuzzy(spark, d):
    return stored(spark, d)[0].find("BRAND_2", fuzzy=True)


@query(f"WITH {SYM}, {FIL}, {SITE} SELECT symbol, file, line FROM site WHERE strpos(symbol, 'Brand12#') > 0")
def resolve_candidates(spark, d):
    g, _ = stored(spark, d)
    symbol, found = g.resolve("Brand12::")
    found = g.get_node(symbol) if found is None and symbol else found
    return (found if found is not None else g.find("")).select("symbol", "file", "line")


def _call_sql(near: str, far: str, where: str = "true") -> str:
    names = {near: "(SELECT symbol FROM sym WHERE id = (SELECT id FROM hub))", far: "s.symbol"}
    return f"WITH {SYM}, {FIL}, {SITE}, {_calls()}, {HUB} SELECT {names['src_id']} AS src, {names['dst_id']} AS dst, f.path AS file, c.line FROM calls c JOIN site s ON s.id = c.{far} LEFT JOIN fil f ON f.id = c.file_id WHERE c.{near} = (SELECT id FROM hub) AND {where}"


@query(_call_sql("dst_id", "src_id"))
def callers(spark, d):
    g, top = stored(spark, d)
    return g.callers(top)


@query(_call_sql("src_id", "dst_id"))
def callees(spark, d):
    g, top = stored(spark, d, "src")
    return g.callees(top)


@query(_call_sql("dst_id", "src_id", f"NOT {_TEST.format('s.file')}"))
def callers_no_tests(spark, d):
    g, top = stored(spark, d)
    return g.callers(top, exclude_tests=True)


@query(_call_sql("src_id", "dst_id", f"NOT {_trivial('s.symbol')}"))
def callees_hide_trivial(spark, d):
    g, top = stored(spark, d, "src")
    return g.callees(top, hide_trivial=True)


@query(_call_sql("dst_id", "src_id", _under("s.file", INCLUDE)))
def callers_include_path(spark, d):
    g, top = stored(spark, d)
    return g.callers(top, include_paths=INCLUDE)


@query(_call_sql("dst_id", "src_id", f"NOT {_under('s.file', EXCLUDE)}"))
def callers_exclude_path(spark, d):
    g, top = stored(spark, d)
    return g.callers(top, exclude_paths=EXCLUDE)


@query(f"WITH {TYPES}, {INH} SELECT b.symbol, NULL::VARCHAR AS display_name, NULL::VARCHAR AS file, NULL::INT AS line FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE a.symbol = 'cxx . . $ nation/NATION_3#'")
def bases(spark, d):
    return types_graph(spark, d).bases("cxx . . $ nation/NATION_3#")


@query(f"WITH {TYPES}, {INH} SELECT a.symbol, NULL::VARCHAR AS display_name, NULL::VARCHAR AS file, NULL::INT AS line FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id WHERE b.symbol = '{TYPE}'")
def subtypes(spark, d):
    return types_graph(spark, d).subtypes(TYPE)


_REF = f"WITH {SYM}, {FIL}, {_calls()}, {HUB}, {REFS}, rx AS (SELECT s.symbol, f.path AS file, r.line, e.symbol AS enclosing FROM refs r JOIN sym s ON s.id = r.symbol_id LEFT JOIN fil f ON f.id = r.file_id LEFT JOIN sym e ON e.id = r.enclosing_id WHERE r.symbol_id = (SELECT id FROM hub))"


@query(f"{_REF} SELECT * FROM rx")
def references_of(spark, d):
    g, top = stored(spark, d)
    return g.references(top)


@query(f"{_REF} SELECT * FROM rx WHERE NOT {_TEST.format('file')}")
def references_no_tests(spark, d):
    g, top = stored(spark, d)
    return g.references(top, exclude_tests=True)


def _hot_sql(ends: list[str], where: str = "true", limit: int = 20) -> str:
    e = f"e AS (SELECT src_id, dst_id FROM calls JOIN site a ON a.id = src_id JOIN site b ON b.id = dst_id WHERE {where})"
    union = " UNION ALL ".join(f"SELECT {c} AS id FROM e" for c in ends)
    return f"WITH {SYM}, {FIL}, {SITE}, {_calls()}, {e}, n AS (SELECT id, count(*)::BIGINT AS n FROM ({union}) GROUP BY id) SELECT symbol, n, (SELECT count(*)::BIGINT FROM n) AS total FROM n JOIN sym USING (id) ORDER BY n DESC, symbol LIMIT {limit}"


@query(_hot_sql(["dst_id"]))
def hotspots_fan_in(spark, d):
    return stored(spark, d)[0].hotspots()


@query(_hot_sql(["src_id"]))
def hotspots_fan_out(spark, d):
    return stored(spark, d)[0].hotspots(kind="fan_out")


@query(_hot_sql(["src_id", "dst_id"]))
def hotspots_edges(spark, d):
    return stored(spark, d)[0].hotspots(kind="edges")


@query(_hot_sql(["dst_id"], f"NOT {_TEST.format('a.file')} AND NOT {_TEST.format('b.file')}"))
def hotspots_no_tests(spark, d):
    return stored(spark, d)[0].hotspots(exclude_tests=True)


@query(_hot_sql(["dst_id"], f"NOT {_under('a.file', EXCLUDE)} AND NOT {_under('b.file', EXCLUDE)}"))
def hotspots_paths(spark, d):
    return stored(spark, d)[0].hotspots(exclude_paths=EXCLUDE)


@query(f"WITH RECURSIVE {SYM}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), {_reach('dst_id', 'src_id', 'p', 'hub')} SELECT symbol FROM r JOIN sym USING (id) WHERE id <> (SELECT id FROM hub)")
def impact_calls(spark, d):
    g, top = stored(spark, d)
    return traverse.impact(g, top).select("symbol")


@query(f"WITH RECURSIVE {SYM}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), {_reach('dst_id', 'src_id', 'p', 'hub', 2)} SELECT symbol, min(depth)::BIGINT AS depth FROM r JOIN sym USING (id) WHERE id <> (SELECT id FROM hub) GROUP BY symbol")
def impact_depth2(spark, d):
    g, top = stored(spark, d)
    return traverse.impact(g, top, 2)


@query(f"WITH RECURSIVE {TYPES}, {INH}, top AS (SELECT id FROM typ WHERE symbol = '{TYPE}'), {_reach('dst_id', 'src_id', 'inh', 'top')} SELECT symbol FROM r JOIN typ USING (id) WHERE symbol <> '{TYPE}'")
def impact_inherits(spark, d):
    return traverse.impact(types_graph(spark, d), TYPE, kind="inherits").select("symbol")


@query(f"WITH RECURSIVE {SYM}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), {_reach('dst_id', 'src_id', 'p', 'hub', 3)} SELECT symbol, min(depth)::BIGINT AS depth FROM r JOIN sym USING (id) WHERE id <> (SELECT id FROM hub) GROUP BY symbol")
def impact_by_joins(spark, d):
    """As impact, with joins of frontiers and none of it on the driver."""
    g, top = stored(spark, d)
    return traverse.impact(g, top, 3, local_pairs=0)


@query(f"WITH RECURSIVE {SYM}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), {_reach('dst_id', 'src_id', 'p', 'hub')} SELECT symbol FROM r JOIN sym USING (id) WHERE id <> (SELECT id FROM hub)")
def impact_all_by_joins(spark, d):
    """As impact_calls, without a bound of depth and with none of it on the driver."""
    g, top = stored(spark, d)
    return traverse.impact(g, top, local_pairs=0).select("symbol")


#: Paths of up to 12 hops; the tables' paths have about four.
_ENDS = f"{SYM}, {FIL}, {_calls()}, {HUB}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), lo AS (SELECT min(src_id) AS id FROM calls), {_reach('src_id', 'dst_id', 'p', 'lo', 12)}, dd AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"
_WALK = f"""{_ENDS}, pre AS (SELECT dst_id, arg_min(src_id, x) AS src_id, min(x) AS x FROM (SELECT dst_id, src_id, {{'s': sym.symbol, 'f': fil.path, 'l': calls.line}} AS x FROM calls JOIN dd a ON a.id = src_id JOIN dd b ON b.id = dst_id AND b.depth = a.depth + 1 JOIN sym ON sym.id = src_id LEFT JOIN fil ON fil.id = calls.file_id) GROUP BY dst_id),
 walk(hop, dst_id, src_id, x) AS (SELECT depth, dst_id, src_id, x FROM pre JOIN dd ON dd.id = dst_id WHERE dst_id = (SELECT id FROM hub) UNION ALL SELECT hop - 1, pre.dst_id, pre.src_id, pre.x FROM walk JOIN pre ON pre.dst_id = walk.src_id WHERE hop > 1)"""


def _ends(g: CodeGraph, top: str) -> tuple[str, str]:
    first = g.edges.agg(F.min("src_id").alias("id")).join(g.symbols, "id").first()["symbol"]
    return first, top


@query(f"WITH RECURSIVE {_ENDS} SELECT depth::BIGINT AS hops FROM dd WHERE id = (SELECT id FROM hub)")
def path_hops(spark, d):
    g, top = stored(spark, d)
    path = traverse.shortest_call_path(g, *_ends(g, top))
    if path is None:
        return spark.range(1).select(F.lit(None).cast("long").alias("hops"))
    return path.agg(F.count(F.lit(1)).alias("hops"))


def _path(spark, d, **how):
    g, top = stored(spark, d)
    path = traverse.shortest_call_path(g, *_ends(g, top), **how)
    return path if path is not None else spark.createDataFrame([], "hop long, src string, dst string, file string, line int")


_PATH = f"WITH RECURSIVE {_WALK} SELECT hop::BIGINT AS hop, (x).s AS src, sym.symbol AS dst, (x).f AS file, (x).l AS line FROM walk JOIN sym ON sym.id = dst_id"


@query(_PATH)
def path_edges(spark, d):
    return _path(spark, d)


@query(_PATH)
def path_edges_by_joins(spark, d):
    return _path(spark, d, local_pairs=0)


def _near(depth: int) -> str:
    return f"WITH RECURSIVE {SYM}, {FIL}, {SITE}, {_calls()}, {HUB}, p AS (SELECT src_id, dst_id FROM calls UNION SELECT dst_id, src_id FROM calls), {_reach('src_id', 'dst_id', 'p', 'hub', depth)}, near AS (SELECT DISTINCT id FROM r)"


_INSIDE = "SELECT a.symbol AS src, b.symbol AS dst, f.path AS file, c.line FROM calls c JOIN site a ON a.id = src_id JOIN site b ON b.id = dst_id LEFT JOIN fil f ON f.id = c.file_id WHERE src_id IN (SELECT id FROM near) AND dst_id IN (SELECT id FROM near)"


@query(f"WITH RECURSIVE {SYM}, {_calls()}, p AS (SELECT DISTINCT src_id, dst_id FROM calls), r(id, far) AS (SELECT id, id FROM sym UNION SELECT id, dst_id FROM r JOIN p ON src_id = far), both_ AS (SELECT a.id, min(a.far) AS component, count(*)::BIGINT AS size FROM r a JOIN r b ON a.id = b.far AND a.far = b.id GROUP BY a.id) SELECT id, component, size FROM both_")
def strong_components(spark, d):
    return components.strong_components(stored(spark, d, "src", names=False)[0])


@query(f"{_near(2)} SELECT symbol FROM near JOIN sym USING (id)")
def subgraph_nodes(spark, d):
    g, top = stored(spark, d)
    return traverse.subgraph(g, top)[0].select("symbol")


@query(f"{_near(2)} {_INSIDE}")
def subgraph_edges(spark, d):
    g, top = stored(spark, d)
    return traverse.subgraph(g, top)[1].select("src", "dst", "file", "line")


@query(f"{_near(1)} {_INSIDE}")
def subgraph_edges_by_joins(spark, d):
    g, top = stored(spark, d)
    return traverse.subgraph(g, top, 1, local_pairs=0)[1].select("src", "dst", "file", "line")


@query(f"{_near(2)} {_INSIDE}")
def subgraph_edges_all_by_joins(spark, d):
    """As subgraph_edges, with none of the search on the driver."""
    g, top = stored(spark, d)
    return traverse.subgraph(g, top, local_pairs=0)[1].select("src", "dst", "file", "line")


@query(f"WITH {OCC}, {SPANS}, {INSIDE}, {BEFORE} SELECT DISTINCT src, dst, doc AS file, line FROM (SELECT * FROM inside UNION ALL SELECT * FROM before_) WHERE src IS NOT NULL")
def build_calls(spark, d):
    return derive.call_edges(demo.occurrences(spark, d)).select("src", "dst", "file", "line")


@query(f"WITH {OCC}, {SPANS}, {INSIDE} SELECT doc, line, dst, src AS container FROM inside")
def build_containment(spark, d):
    o = demo.occurrences(spark, d)
    uses = o.filter(symbols.is_callable(F.col("symbol")) & derive.is_use(F.col("symbol_roles"))).select("doc", "line", F.col("symbol").alias("dst")).distinct()
    spans = derive.intervals(o, symbols.is_callable(F.col("symbol")))
    return derive.innermost(uses.join(spans.select("doc").distinct(), "doc", "left_semi"), spans).select("doc", "line", "dst", "container")


@query(f"WITH {OCC}, use_ AS (SELECT DISTINCT doc, line, symbol AS dst FROM occ WHERE symbol_roles & 65 = 0 AND {_FN}), def_ AS (SELECT doc, line, max(symbol) AS name FROM occ WHERE symbol_roles & 1 <> 0 AND {_FN} GROUP BY doc, line) SELECT doc, line, dst, (SELECT arg_max(name, line) FROM def_ WHERE def_.doc = u.doc AND def_.line <= u.line) AS container FROM use_ u")
def build_preceding(spark, d):
    o = demo.occurrences(spark, d).filter(symbols.is_callable(F.col("symbol")))
    uses = o.filter(derive.is_use(F.col("symbol_roles"))).select("doc", "line", F.col("symbol").alias("dst")).distinct()
    return derive.preceding(uses, o.filter(derive.is_definition(F.col("symbol_roles"))).select("doc", "line", "symbol")).select("doc", "line", "dst", "container")


@query(f"WITH {OCC}, {SPANS}, {INSIDE} SELECT count(*)::BIGINT AS sites, count(*) FILTER (WHERE src IS NULL)::BIGINT AS dropped FROM inside")
def build_calls_drop_rule(spark, d):
    return build_containment(spark, d).agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("container").isNull()).alias("dropped"))


@query(f"WITH {OCC} SELECT DISTINCT symbol, doc AS file, line FROM occ WHERE symbol_roles & 65 = 0")
def build_refs(spark, d):
    return derive.references(demo.occurrences(spark, d)).select("symbol", "file", "line")


@query(f"WITH {OCC}, span AS (SELECT doc, symbol AS container, enc_start AS s, enc_end AS e, doc_ord, occ_ord FROM occ WHERE symbol_roles & 1 <> 0 AND enc_start IS NOT NULL AND ({_FN} OR {_TY})) SELECT DISTINCT symbol, doc AS file, line, (SELECT arg_max(container, (s, doc_ord, occ_ord)) FROM span WHERE span.doc = u.doc AND s <= u.line AND u.line <= e) AS enclosing FROM occ u WHERE symbol_roles & 65 = 0")
def build_refs_attributed(spark, d):
    return derive.references(demo.occurrences(spark, d), attribute=True)


@query(f"WITH {OCC} SELECT symbol, arg_min(doc, (doc_ord, occ_ord)) AS file, arg_min(line, (doc_ord, occ_ord)) AS line FROM occ WHERE symbol_roles & 1 <> 0 GROUP BY symbol")
def build_def_sites(spark, d):
    return derive.definition_sites(demo.occurrences(spark, d))


@query(f"WITH {INH}, {TYPES} SELECT CASE WHEN ends_with(a.symbol, '#') AND ends_with(b.symbol, '#') THEN 'inherits' ELSE 'implements' END AS kind, a.symbol AS src, b.symbol AS dst FROM inh JOIN typ a ON a.id = src_id JOIN typ b ON b.id = dst_id")
def relationship_kinds(spark, d):
    t = demo.types(spark, d).select("id", "symbol")
    e = demo.inherits(spark, d).join(t.select(F.col("id").alias("src_id"), F.col("symbol").alias("src")), "src_id").join(t.select(F.col("id").alias("dst_id"), F.col("symbol").alias("dst")), "dst_id")
    return derive.relationship_edges(e.select("src", "dst", F.lit(True).alias("is_implementation"), F.lit("types.h").alias("doc"))).select("kind", "src", "dst")


@query(f"WITH {SYM} SELECT symbol, {_label('symbol')} AS label, {_qualified('symbol')} AS qualified, {_leaf('symbol')} AS leaf FROM sym")
def labels(spark, d):
    s = F.col("symbol")
    return demo.symbols(spark, d).select("symbol", symbols.short_label(s).alias("label"), symbols.qualified_name(s).alias("qualified"), symbols.leaf_name(s).alias("leaf"))


@query(f"WITH {OCC} SELECT DISTINCT symbol, CASE WHEN {_FN} THEN 'callable' WHEN {_TY} THEN 'type' ELSE 'other' END AS kind FROM occ")
def symbol_kind(spark, d):
    return demo.occurrences(spark, d).select("symbol", symbols.symbol_kind(F.col("symbol")).alias("kind")).distinct()


@query(f"WITH {FIL} SELECT path, {_under('path', INCLUDE)} AS included, NOT {_under('path', EXCLUDE)} AS not_excluded FROM fil")
def path_prefix(spark, d):
    p = F.col("path")
    return demo.files(spark, d).select("path", paths.path_ok(p, INCLUDE).alias("included"), paths.path_ok(p, None, EXCLUDE).alias("not_excluded"))


@query(f"WITH {SYM} SELECT symbol, {_trivial('symbol')} AS trivial, {_trivial('symbol')} OR contains(symbol, '$anonymous_type') AS noise FROM sym")
def trivial_symbols(spark, d):
    s = F.col("symbol")
    return demo.symbols(spark, d).select("symbol", symbols.is_trivial_callee(s).alias("trivial"), symbols.is_noise(s).alias("noise"))


@query(f"WITH {SYM} SELECT {_qualified('symbol')} AS qualified, count(*)::BIGINT AS overloads, min(symbol) AS first FROM sym GROUP BY 1")
def overload_groups(spark, d):
    return replies.overload_groups(demo.symbols(spark, d).select("symbol", F.lit("").alias("file"), "line")).select("qualified", "overloads", "first")


@query(f"{_REF} SELECT 'file:' || file AS target, count(*)::BIGINT AS weight FROM rx WHERE file IS NOT NULL GROUP BY file")
def usage_by_file(spark, d):
    g, top = stored(spark, d)
    return replies.usage_by_file(g, top).select("target", "weight")


@query(f"{_REF} SELECT coalesce(enclosing, 'file:' || file) AS target, CASE WHEN enclosing IS NULL THEN 'references' ELSE 'used_by' END AS relation, count(*)::BIGINT AS weight FROM rx GROUP BY 1, 2")
def usage_by_symbol(spark, d):
    g, top = stored(spark, d)
    return replies.usage_by_symbol(g, top).select("target", "relation", "weight")


@query(f"WITH {SYM}, {_calls()}, {HUB} SELECT (SELECT count(*)::BIGINT FROM calls WHERE dst_id = (SELECT id FROM hub)) AS total, (SELECT count(*) > 40 FROM calls WHERE dst_id = (SELECT id FROM hub)) AS truncated, least(40, (SELECT count(*) FROM calls WHERE dst_id = (SELECT id FROM hub)))::INT AS shown")
def reply_callers(spark, d):
    g, top = stored(spark, d)
    return replies.callers(g, top, exclude_tests=False).select("total", "truncated", F.size("results").alias("shown"))


@query(f"WITH {SYM}, {_calls()}, keep AS (SELECT 'calls' AS kind, src_id, dst_id, file_id, line FROM calls WHERE file_id % 10 <> 0), new AS (SELECT 'calls' AS kind, src_id, dst_id, file_id, line + 1 AS line FROM calls WHERE file_id % 10 = 0 AND line % 2 = 0) SELECT * FROM keep UNION ALL SELECT * FROM new")
def update_replace_files(spark, d):
    g, _ = stored(spark, d)
    changed = g.files.filter("id >= 1000000000 and id % 10 = 0")
    s = g.symbols.select("id", "symbol")
    part = g.edges.filter("file_id % 10 = 0 and line % 2 = 0").withColumn("line", (F.col("line") + 1).cast("int"))
    e = part.join(s.select(F.col("id").alias("src_id"), F.col("symbol").alias("src")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("symbol").alias("dst")), "dst_id").join(g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("kind", "src", "dst", "file", "line")
    nodes = e.select(F.col("src").alias("symbol")).union(e.select("dst")).distinct().select("symbol", F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    none = spark.createDataFrame([], "symbol string, file string, line int, enclosing string")
    return updated(spark, d, {"nodes": nodes, "edges": e, "refs": none}, changed.select(F.col("path").alias("doc")))[0].edges


@query(f"WITH {SYM}, {_calls()}, gone AS (SELECT * FROM calls WHERE file_id % 2 = 0), keep AS (SELECT * FROM calls WHERE file_id % 2 <> 0) SELECT id FROM (SELECT src_id AS id FROM calls UNION SELECT dst_id FROM calls) WHERE id IN (SELECT src_id FROM keep UNION SELECT dst_id FROM keep)")
def update_gc_orphans(spark, d):
    """Symbols without a definition site: those that only deleted files used are dropped."""
    g = calls_graph(spark, d)
    used = g.edges.select(F.col("src_id").alias("id")).union(g.edges.select("dst_id")).distinct()
    bare = g.symbols.join(used, "id", "left_semi").withColumns({"file_id": F.lit(None).cast("long"), "line": F.lit(None).cast("int")})
    lone = CodeGraph(g.files, bare, g.edges)
    none = {"nodes": spark.createDataFrame([], "symbol string, display_name string, file string, line int"), "edges": spark.createDataFrame([], "kind string, src string, dst string, file string, line int"), "refs": spark.createDataFrame([], "symbol string, file string, line int, enclosing string")}
    deleted = g.files.filter("id >= 1000000000 and id % 2 = 0").select(F.col("path").alias("doc"))
    path = fresh_path(spark, "lone")
    store.save(lone, path)
    store.update(spark, path, none, spark.createDataFrame([], "doc string"), deleted)
    return store.load(spark, path).symbols.select("id")


@query(f"WITH {REFS} SELECT symbol_id, file_id, line, CASE WHEN symbol_id % 3 = 0 THEN symbol_id ELSE enclosing_id END AS enclosing_id FROM refs")
def enrich_refs(spark, d):
    g = calls_graph(spark, d)
    new = g.refs.filter("symbol_id % 3 = 0").join(g.symbols.select(F.col("id").alias("symbol_id"), "symbol"), "symbol_id").join(g.files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id").select("symbol", "file", "line", F.col("symbol").alias("enclosing")).distinct()
    return store.enrich(g, new)[0].refs


@query("SELECT o_orderkey AS id, CASE WHEN n > 0 AND (o_custkey % 40 + o_orderkey % 7) / n >= 0.25 THEN 'rebuild' ELSE 'update' END AS verdict FROM (SELECT *, (o_orderkey % 90)::DOUBLE AS n FROM orders)")
def staleness(spark, d):
    o = demo.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), freshness.staleness(F.col("o_custkey") % 40, F.col("o_orderkey") % 7, (F.col("o_orderkey") % 90).cast("double")).alias("verdict"))


@query(f"WITH {FIL}, f AS (SELECT path, {_TEST.format('path')} AS test FROM fil) SELECT array_to_string(string_split(path, '/')[1:least(2, len(string_split(path, '/')) - 1)], '/') AS key, count(*)::BIGINT AS units, count(*) FILTER (WHERE test)::BIGINT AS tests FROM f GROUP BY 1")
def scope_summary(spark, d):
    f = demo.files(spark, d)
    return f.groupBy(compdb.group_key(F.col("path")).alias("key")).agg(F.count(F.lit(1)).alias("units"), F.count_if("is_test").alias("tests"))


@query(f"WITH {SYM}, {_calls()}, {REFS} SELECT (SELECT count(*) FROM sym)::VARCHAR AS node_count, (SELECT count(*) FROM calls)::VARCHAR AS edge_count, (SELECT count(*) FROM refs)::VARCHAR AS ref_count, (SELECT count(enclosing_id) FROM refs)::VARCHAR AS attributed_ref_count")
def meta_counts(spark, d):
    c = store.counts(calls_graph(spark, d))
    return spark.range(1).select(*(F.lit(c[k]).alias(k) for k in ("node_count", "edge_count", "ref_count", "attributed_ref_count")))


@query("SELECT coalesce(max(CASE p_size % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END), 0)::BIGINT AS rank FROM part WHERE p_size >= 20 AND p_size < 40")
def max_rebuild_level(spark, d):
    p = demo.table(spark, d, "part")
    level = F.when(F.col("p_size") % 3 == 1, "store").when(F.col("p_size") % 3 == 2, "reindex").otherwise("none")
    releases = p.select(F.concat(F.lit("v1."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string")).alias("version"), level.alias("level"))
    return versions.max_rebuild_level(releases, "1.20", "1.40").select("rank")


@query("WITH s AS (SELECT DISTINCT user_id AS u, (event_id % 50)::INT AS line FROM events) SELECT DISTINCT 'u' || u AS file, greatest(line + o, 0)::INT AS line FROM s, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) WHERE line + o >= 0")
def merged_windows(spark, d):
    e = demo.table(spark, d, "events")
    return snippets.windows(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 50).cast("int").alias("line")), 2)


@query("SELECT 'u' || user_id AS file, count(DISTINCT event_id % 50)::INT AS n_lines, min(event_id % 50)::INT AS first FROM events GROUP BY user_id")
def refs_by_file(spark, d):
    e = demo.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 50).cast("int").alias("line"))
    return snippets.lines_by_file(e).select("file", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("first"))


@query(f"WITH {SYM}, {FIL}, w AS (SELECT DISTINCT path FROM fil) SELECT path, (row_number() OVER (ORDER BY path))::BIGINT AS id FROM w")
def intern_files(spark, d):
    f = demo.files(spark, d).select("path").distinct().withColumn("o", F.lit(0))
    return store.dense_ids(f, "path", "o")
