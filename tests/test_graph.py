"""Derivation, point queries, traversals, stores and replies on small graphs."""

import datetime
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stellate import queries, schema
from stellate.operators import derive, freshness, store
from stellate.plans import components, layers, locate, replies, traverse
from stellate.plans.graph import CodeGraph
from stellate.session import settings
from stellate.sources import compdb, demo, graphjson, scip, snippets
from stellate.streaming import updates

P = "cxx . . $ "
M = lambda n: f"{P}{n}()."
T = lambda n: f"{P}{n}#"


def occ(spark, *docs):
    """docs: (path, [(symbol, roles, line, start, end)])"""
    rows = [(i, path, k, s, roles, line, a, b) for i, (path, items) in enumerate(docs) for k, (s, roles, line, a, b) in enumerate(items)]
    return spark.createDataFrame(rows, schema.OCCURRENCES)


def D(s, line, a=None, b=None):  # noqa: N802
    return (s, 1, line, a, b)


def U(s, line, roles=0):  # noqa: N802
    return (s, roles, line, None, None)


def calls(df):
    return sorted((r["src"], r["dst"]) for r in derive.call_edges(df).collect())


def no_info(spark):
    return spark.createDataFrame([], schema.SYMBOL_INFO), spark.createDataFrame([], schema.RELATIONSHIPS)


def test_calls(spark):
    a, b, h = M("outer"), M("inner"), M("helper")
    assert calls(occ(spark, ("a", [D(M("ca"), 10), D(M("m"), 5), U(M("m"), 15)]), ("b", [D(M("cb"), 1), D(h, 5), U(h, 3)]))) == [(M("ca"), M("m")), (M("cb"), h)]
    assert calls(occ(spark, ("a", [D(a, 5, 5, 30), D(b, 10, 10, 12), U(h, 20), U(h, 11)]))) == [(b, h), (a, h)]
    assert calls(occ(spark, ("a", [D(a, 5), D(b, 10), U(h, 20)]))) == [(b, h)]
    dropped = [D(M("sib"), 5, 5, 10), U(M("decl"), 15), D(a, 20, 20, 40), U(h, 25)]
    assert calls(occ(spark, ("a", dropped))) == [(a, h)]
    assert calls(occ(spark, ("a", [D(a, 1), U(h, 2), U(h, 2)]))) == [(a, h)]
    assert calls(occ(spark, ("a", [D(M("x"), 3), D(M("y"), 3), U(h, 3), U(h, None), U(h, 4, 64), U(T("t"), 5)]))) == [(M("y"), h)]
    assert calls(occ(spark, ("a", [U(h, 2)]))) == []


def slow_innermost(spans, line):
    held = [(s, k) for k, (s, e) in enumerate(spans) if s <= line <= e]
    return max(held)[1] if held else None


def test_innermost_holds_for_any_spans(spark):
    rng = random.Random(2)
    docs, want = [], {}
    for d in range(15):
        spans = [(s, s + rng.randint(-1, 900)) for s in (rng.randint(0, 1000) for _ in range(12))]
        lines = sorted({rng.randint(0, 1500) for _ in range(30)})
        docs.append((f"d{d}", [*(D(M(f"f{k}"), s, s, e) for k, (s, e) in enumerate(spans)), *(U(M("g"), x) for x in lines)]))
        for x in lines:
            k = slow_innermost(spans, x)
            want[f"d{d}", x] = None if k is None else M(f"f{k}")
    df = occ(spark, *docs)
    sites = df.filter("symbol_roles = 0").select("doc", "line")
    got = {(r["doc"], r["line"]): r["container"] for r in derive.innermost(sites, derive.intervals(df, F.lit(True))).collect()}
    assert got == want


def test_references(spark):
    df = occ(spark, ("a", [D(T("C"), 1, 1, 50), D(M("m"), 10, 10, 20), U(T("W"), 15), U(T("W"), 3), U("local 4", 9), U(T("W"), 60)]), ("h", [U(T("F"), 3)]), ("h", [U(T("F"), 3)]))
    got = {(r["symbol"], r["line"]): r["enclosing"] for r in derive.references(df, True).collect()}
    assert got == {(T("W"), 15): M("m"), (T("W"), 3): T("C"), (T("W"), 60): None, (T("F"), 3): None}
    assert {r["enclosing"] for r in derive.references(df).collect()} == {None}


def test_nodes_and_relationships(spark):
    info = spark.createDataFrame([(0, "a", 0, T("W"), ""), (0, "a", 1, T("W"), "W"), (1, "b", 0, T("W"), "other"), (0, "a", 2, T("N"), None)], schema.SYMBOL_INFO)
    rel = spark.createDataFrame([(0, "a", 0, T("D"), T("B"), True), (0, "a", 1, M("D#f"), M("B#f"), True), (0, "a", 2, T("X"), T("Y"), False)], schema.RELATIONSHIPS)
    df = occ(spark, ("a", [D(T("W"), None), D(T("W"), 41)]), ("b", [D(T("W"), 7), D("local 1", 3)]))
    built = derive.build(df, info, rel)
    nodes = {r["symbol"]: (r["display_name"], r["file"], r["line"]) for r in built["nodes"].collect()}
    assert nodes[T("W")] == ("W", "a", 41) and nodes[T("N")] == (None, None, None) and nodes["local 1"] == (None, "b", 3)
    assert {(r["kind"], r["src"]) for r in built["edges"].collect()} == {("inherits", T("D")), ("implements", M("D#f"))}
    assert derive.build(df, info, rel, drop_locals=True)["nodes"].filter("symbol like 'local%'").count() == 0


def graph(spark, edges, sites=None, refs=None):
    """edges: (kind, src, dst, file, line); sites: symbol -> (file, line); refs: (symbol, file, line, enclosing)"""
    sites, refs = sites or {}, refs or []
    names = sorted({x for e in edges for x in e[1:3]} | set(sites) | {r[0] for r in refs} | {r[3] for r in refs if r[3]})
    nodes = [(n, n.split()[-1] if n.startswith("x") else None, *sites.get(n, (None, None))) for n in names]
    return store.intern(
        {
            "nodes": spark.createDataFrame(nodes, "symbol string, display_name string, file string, line int"),
            "edges": spark.createDataFrame(edges, "kind string, src string, dst string, file string, line int"),
            "refs": spark.createDataFrame(refs, "symbol string, file string, line int, enclosing string"),
        }
    )


def C(a, b, file="f.cpp", line=1):  # noqa: N802
    return ("calls", M(a), M(b), file, line)


def test_find_and_resolve(spark):
    m, c, o = P + "Foo#makeResumeToken(a1b2c3).", P + "Foo#caller(a2b2c3).", P + "Bar#other(aaaaaa)."
    g = graph(spark, [("calls", c, m, "foo.cpp", 9), ("calls", o, o, "foo.cpp", 1)])
    assert [tuple(r) for r in g.callers(m).collect()] == [(c, m, "foo.cpp", 9)]
    assert g.find("makeResumeToken").count() == 1 and g.find("makeresumetoken").count() == 0 and g.find("make_resumetoken", True).count() == 1
    assert g.find("Token Foo").count() == 1 and g.find("  ").count() == 0
    for q in (m, "makeResumeToken", "Foo::makeResumeToken", "makeresumetoken"):
        assert g.resolve(q) == (m, None)
    symbol, found = g.resolve("Foo")
    assert symbol is None and found.count() == 2
    assert g.resolve("nothing") == (None, None)
    r = replies.callers(g, "Foo").first()
    assert r["ambiguous"] and r["total"] == 2
    assert replies.find(g, "maKEresume").first()["relaxed"] == "fuzzy"
    assert replies.find(g, "Wrong#other").first()["relaxed"] == "leaf"
    assert replies.find(g, "zzz").first()["relaxed"] is None


def test_hierarchy(spark):
    e = [("inherits", T("Leaf"), T("Derived"), "b.h", None), ("inherits", T("Derived"), T("Base"), "b.h", None), C("a", "b")]
    g = graph(spark, e, {T("Base"): ("b.h", 1)})
    assert [tuple(r)[:1] + tuple(r)[2:] for r in g.bases(T("Derived")).collect()] == [(T("Base"), "b.h", 1)]
    assert [r["symbol"] for r in g.subtypes(T("Base")).collect()] == [T("Derived")]
    for pairs in (traverse.LOCAL_PAIRS, 0):
        assert {r["symbol"] for r in traverse.impact(g, T("Base"), kind="inherits", local_pairs=pairs).collect()} == {T("Derived"), T("Leaf")}
    assert traverse.impact(g, T("Base")).count() == 0 and traverse.impact(g, "unknown").count() == 0
    r = replies.impact(g, T("Base")).first()
    assert r["is_type"] and r["reference_sites"] == 0 and r["notice"]


@pytest.mark.parametrize("pairs", [traverse.LOCAL_PAIRS, 0])
def test_paths_and_subgraphs(spark, pairs):
    g = graph(spark, [C("a", "b"), C("b", "c"), C("d", "a"), C("b", "b"), C("x", "y")])
    path = traverse.shortest_call_path(g, M("a"), M("c"), pairs)
    assert [(r["hop"], r["src"], r["dst"]) for r in path.collect()] == [(1, M("a"), M("b")), (2, M("b"), M("c"))]
    assert traverse.shortest_call_path(g, M("a"), M("a"), pairs).count() == 0
    assert traverse.shortest_call_path(g, M("c"), M("a"), pairs) is None and traverse.shortest_call_path(g, M("a"), "no", pairs) is None
    assert {r["symbol"] for r in traverse.impact(g, M("b"), local_pairs=pairs).collect()} == {M("a"), M("d")}
    assert {r["symbol"] for r in traverse.impact(g, M("b"), 1, local_pairs=pairs).collect()} == {M("a")}
    assert traverse.impact(g, M("b"), 0, local_pairs=pairs).count() == 0
    nodes, edges = traverse.subgraph(g, M("a"), 1, local_pairs=pairs)
    assert {r["symbol"] for r in nodes.collect()} == {M("a"), M("b"), M("d")}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(M("a"), M("b")), (M("d"), M("a")), (M("b"), M("b"))}
    assert {r["symbol"] for r in traverse.subgraph(g, M("a"), 2, "out", pairs)[0].collect()} == {M("a"), M("b"), M("c")}
    assert {r["symbol"] for r in traverse.subgraph(g, M("a"), 2, "sideways", pairs)[0].collect()} == {M("a")}
    assert traverse.subgraph(g, "no", 2, "out", pairs)[0].count() == 0


def slow_path(edges, one, two):
    """The shortest path that from the end backwards has the least symbol, file and line; by trying all edges."""
    depth, front = {one: 0}, [one]
    while front:
        new = sorted({e[2] for e in edges if e[1] in front} - set(depth))
        depth |= {x: max(depth.values()) + 1 for x in new}
        front = new
    if two not in depth:
        return None
    out, at = [], two
    while at != one:
        e = min((e for e in edges if e[2] == at and depth.get(e[1]) == depth[at] - 1), key=lambda e: (e[1], e[3], e[4]))
        out.append((depth[at], *e[1:]))
        at = e[1]
    return out[::-1]


@pytest.mark.parametrize("hot", [traverse.HOT, 3])
def test_both_ways_agree_on_random_graphs(spark, monkeypatch, hot):
    """Also with symbols whose edges are dealt over salted keys, and more levels than are kept apart."""
    monkeypatch.setattr(traverse, "HOT", hot)
    monkeypatch.setattr(traverse, "COMPACT", 2)
    rng = random.Random(hot)
    edges = [C(f"n{k:02}", f"n{rng.choice([k + 1, k + 1, k + 2, rng.randrange(30)]) % 30:02}", f"f{rng.randrange(3)}", rng.randrange(9)) for k in [*range(30), 5, 5, 5, 7, 9, 11]]
    g = graph(spark, edges)
    for a, b in (("n00", "n17"), ("n20", "n03")):
        want = slow_path(edges, M(a), M(b))
        for pairs in (traverse.LOCAL_PAIRS, 0):
            path = traverse.shortest_call_path(g, M(a), M(b), pairs)
            assert (path and [tuple(r) for r in path.collect()]) == want
    most = max(M(f"n{k:02}") for k in range(30) if slow_path(edges, M("n00"), M(f"n{k:02}")))
    one, two = ({tuple(r) for r in traverse.impact(g, most, local_pairs=n).collect()} for n in (traverse.LOCAL_PAIRS, 0))
    assert one == two and len(one) > 5
    assert (traverse.laid(g, "calls", "out").hot is None) == (hot > 3)


def test_subgraph_moves_what_it_found(spark):
    """Names and paths come from the symbols and files of the subgraph; the whole tables aren't sorted for it."""
    g = graph(spark, [C("a", "b"), C("b", "c"), C("x", "y", "other.cpp")])
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        edges = traverse.subgraph(g, M("a"), local_pairs=0)[1]
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1  # of files; symbols and edges were cut
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [(M("a"), M("b")), (M("b"), M("c"))]
    assert not g.laid  # two edges far: edges are scanned, not laid out
    assert traverse.reach(g, 1, None, "both", 9, 0).count() > 1 and g.laid


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, monkeypatch, seed):
    """Against mutual reachability; chains, cycles side by side and within each other, and self-calls."""
    monkeypatch.setattr(components, "COMPACT", 1)
    rng = random.Random(seed)
    edges = [C(f"c{k}", f"c{(k + 1) % 5}") for k in range(5)] + [C(f"d{k}", f"d{k + 1}") for k in range(6)] + [C("d6", "c0"), C("s", "s")]
    edges += [C(f"r{rng.randrange(25)}", f"r{rng.randrange(25)}") for _ in range(30)]
    g = graph(spark, edges)
    ids = {r["symbol"]: r["id"] for r in g.symbols.collect()}
    far = {s: {s} for s in ids}
    for _ in ids:
        for e in edges:
            far[e[1]] |= far[e[2]]
    want = set()
    for s in ids:
        own = [ids[t] for t in far[s] if s in far[t]]
        want.add((ids[s], min(own), len(own)))
    assert {tuple(r) for r in components.strong_components(g).collect()} == want
    assert components.strong_components(CodeGraph(g.files, g.symbols, g.edges.limit(0))).count() == len(ids)


@pytest.mark.parametrize("rounds", [1, 16])
def test_strong_components_of_a_dense_graph(spark, monkeypatch, rounds):
    """Rounds over all edges see what is left between groups found over a few of them; these may be found in part only."""
    monkeypatch.setattr(components, "ROUNDS", rounds, raising=False)
    whole, seen = components._trimmed, []
    monkeypatch.setattr(components, "_trimmed", lambda edges: seen.append(edges.count()) or whole(edges))
    rng = random.Random(3)
    dense = {(k, x, y) for k in range(3) for x in range(40) for y in rng.sample(range(40), 12) if x != y}
    edges = [C(f"k{k}x{x}", f"k{k}x{y}") for k, x, y in sorted(dense)] + [C("k0x1", "k1x1"), C("k1x2", "k2x2"), C("k2x3", "t")]
    g = graph(spark, edges)
    made = lambda: set((Path(components.fresh_path(spark, "x").removeprefix("file://")).parent).glob("**/rdd-*"))
    kept = made()
    got = {r["id"]: (r["component"], r["size"]) for r in components.strong_components(g).collect()}
    assert made() == kept  # cuts are removed
    ids = {r["symbol"]: r["id"] for r in g.symbols.collect()}
    group = lambda s: [ids[M(f"k{s}x{x}")] for x in range(40)]
    assert got == {ids[M("t")]: (ids[M("t")], 1)} | {i: (min(group(k)), 40) for k in range(3) for i in group(k)}
    if rounds == 16:
        assert seen and seen[0] < len(edges) / 10


def test_store_without_names(spark, monkeypatch):
    """Components are found in a store that has no index of names yet; who searches names gets one on the same store."""
    indexed, index = [], store.index_names
    monkeypatch.setattr(store, "index_names", lambda *a: indexed.append(a) or index(*a))
    monkeypatch.setattr(queries, "_STORES", {})
    monkeypatch.setattr(queries, "_NAMED", set(), raising=False)
    d = "/root/testdata/sf0.001"
    assert queries.QUERIES["strong_components"](spark, d).count() == demo.symbols(spark, d).count() and not indexed
    path, _ = queries.store_of(spark, d)
    assert queries.stored(spark, d)[0].names is not None and queries.store_of(spark, d)[0] == path and len(indexed) == 1


def test_symbols_at_lines(spark, tmp_path):
    """Also after an update, a reopening and a compaction, and where nothing is known."""
    path = f"file://{tmp_path}/g"
    build = lambda *docs: derive.build(occ(spark, *docs), *no_info(spark), spans=True)
    store.save(store.intern(build(("a", [D(T("C"), 1, 1, 900), D(M("m"), 10, 10, 700), D(M("n"), 10, 10, 20)]), ("b", [D(M("x"), 3, 3, 5)]))), path)
    sites = spark.createDataFrame([("a", 0), ("a", 1), ("a", 15), ("a", 699), ("a", 900), ("b", 4), ("none", 4), ("b", None)], "file string, line int")
    at = lambda: {(r["file"], r["line"]): r["symbol"] for r in locate.symbols_at(store.load(spark, path), sites).collect()}
    want = {("a", 0): None, ("a", 1): T("C"), ("a", 15): M("n"), ("a", 699): M("m"), ("a", 900): T("C"), ("b", 4): M("x"), ("none", 4): None, ("b", None): None}
    assert at() == want
    store.update(spark, path, build(("b", [D(M("y"), 4, 4, 4)])), spark.createDataFrame([("b",)], "doc string"))
    assert at() == want | {("b", 4): M("y")}
    store.compact(spark, path)
    assert at() == want | {("b", 4): M("y")}
    with pytest.raises(ValueError):
        locate.symbols_at(graph(spark, [C("a", "b")]), sites)


def test_tables_are_derived_once(spark):
    """With `keep` no table of a build derives the others anew: nodes join what was kept of edges and references."""
    o = occ(spark, ("a", [D(M("x"), 1, 1, 9), U(M("y"), 3), D(M("y"), 20)]))
    kept = []
    built = derive.build(o, *no_info(spark), keep=lambda df: kept.append(df.checkpoint()) or kept[-1])
    assert kept == [built["edges"], built["refs"], built["nodes"]] and "Exchange" not in built["nodes"]._jdf.queryExecution().sparkPlan().toString()
    plain = derive.build(o, *no_info(spark))
    assert all(sorted(built[k].collect(), key=str) == sorted(plain[k].collect(), key=str) for k in plain)


def test_a_layer_of_many_files(spark):
    """Files aren't dealt by what their paths begin with, which all may share; layers of several lengths, and one told twice."""
    files = spark.createDataFrame([(1, "src/a/x.cpp"), (2, "src"), (3, "srcs/a"), (4, "/abs/x"), (5, None), (6, "src/b/c/d")], "id long, path string")
    layer = spark.createDataFrame([("src", "core", 1), ("src/", "core", 1), ("src/a/", "a", 2), ("src/b/c/d/", "d", None), ("", "root", 0), (None, "none", 9)], "prefix string, layer string, rank int")
    got = layers.file_layers(files, layer)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 2), (2, "core", 1), (4, "root", 0), (6, "d", None)]
    assert layers.file_layers(files, layer.limit(0)).count() == 0


def test_layers_and_costs(spark):
    g = graph(spark, [C("a", "b"), C("b", "c"), C("c", "a"), C("d", "a"), C("a", "e")], {M("a"): ("x/low/a.cpp", 1), M("b"): ("x/high/b.cpp", 1), M("c"): ("x/lowest", 1), M("d"): ("y.cpp", 1)})
    layer = spark.createDataFrame([("x/low", "low", 1), ("x/high/", "high", 3), ("x", "mid", 2)], "prefix string, layer string, rank int")
    got = layers.boundary_violations(g, layer)
    assert {(r["src"], r["dst"], r["src_layer"], r["dst_layer"]) for r in got.collect()} == {(M("a"), M("b"), "low", "high")}
    ids = {r["id"]: r["symbol"] for r in g.symbols.collect()}
    cost = lambda **how: {ids[r["id"]]: (r["n"], r["is_exact"]) for r in layers.dependency_cost(g, **how).collect()}
    assert cost() == {M("a"): (3, True), M("b"): (3, True), M("c"): (3, True), M("d"): (4, True), M("e"): (0, True)}
    assert cost(exact=3) == {M("a"): (3, False), M("b"): (3, False), M("c"): (3, False), M("d"): (4, False), M("e"): (0, True)}
    g = graph(spark, [C("top", f"n{k:04}") for k in range(3000)] + [C("n0000", "n0001")])
    top = next(r["id"] for r in g.symbols.filter(F.col("symbol") == M("top")).collect())
    n = layers.dependency_cost(g).filter(F.col("id") == top).first()["n"]
    assert abs(n - 3000) < 3000 * 3 * 1.04 / 2 ** (layers.LG_K / 2)


def test_rounds_move_no_edges(spark):
    """A round's plan has one exchange, of the ends found; neither edges nor the frontier are dealt anew."""
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        ball = traverse.Ball(1, traverse.laid(graph(spark, [C("a", "b"), C("b", "c")]), "calls", "out"))
        ball.grow()
        new = ball.edges.ends(ball.levels[-1]).join(ball.levels[0], "id", "left_anti")
        plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_hotspots(spark):
    e = [C(f"c{i}", "hot") for i in range(1, 6)] + [C(f"c{i}", "warm") for i in range(1, 4)] + [C("c1", "cold"), C("rec", "rec")]
    g = graph(spark, e, {M("c1"): ("src/foo_test.cpp", 0), M("c2"): ("vendor/x.cpp", 0)})
    assert [(r["symbol"], r["n"], r["total"]) for r in g.hotspots(limit=2).collect()] == [(M("hot"), 5, 4), (M("warm"), 3, 4)]
    assert g.hotspots(1, "fan_out").first()["n"] == 3
    assert {r["symbol"]: r["n"] for r in g.hotspots(kind="edges").collect()}[M("rec")] == 2
    assert g.hotspots(exclude_tests=True).first()["n"] == 4 and g.hotspots(exclude_paths=["vendor"]).first()["n"] == 4
    for bad in ({"kind": "bogus"}, {"limit": -1}):
        with pytest.raises(ValueError):
            g.hotspots(**bad)
    r = replies.hotspots(g, limit=1).first()
    assert r["total"] == 4 and r["truncated"] and r["results"][0]["n"] == 5


def test_replies(spark):
    sites = {M("run"): ("src/run.cpp", 4), M("t"): ("src/tests/t.cpp", 0)}
    e = [C("run", "work"), ("calls", M("run"), P + "operator==(aaaaaa).", "f.cpp", 2), C("run", "tassert"), C("t", "work", "src/tests/t.cpp", 7)]
    g = graph(spark, e, sites, [(T("W"), "a.cpp", 11, M("run")), (T("W"), "a.cpp", 40, M("run")), (T("W"), "b/c.cpp", 7, None)])
    r = replies.callees(g, M("run"), hide_trivial=True).first()
    assert r["total"] == 1 and r["trivial_hidden"] == 2 and r["results"][0]["symbol"] == "work()."
    assert replies.callers(g, M("work")).first()["total"] == 1 and replies.callers(g, M("work"), exclude_tests=False).first()["total"] == 2
    assert replies.callers(g, M("work"), limit=1, exclude_tests=False).first()["truncated"]
    assert [(r["file"], r["line"]) for r in g.references(T("W")).collect()] == [("a.cpp", 11), ("a.cpp", 40), ("b/c.cpp", 7)]
    assert {(r["target"], r["weight"]) for r in replies.usage_by_file(g, T("W")).collect()} == {("file:a.cpp", 2), ("file:b/c.cpp", 1)}
    assert {(r["target"], r["relation"], r["weight"]) for r in replies.usage(g, T("W")).collect()} == {(M("run"), "used_by", 2), ("file:b/c.cpp", "references", 1)}
    r = replies.references(g, T("W")).first()
    assert r["available"] and [x["line"] for x in r["results"]] == [12, 41, 8]
    r = replies.explain(g, M("work")).first()
    assert r["node"]["symbol"] == M("work") and r["callers"]["total"] == 1 and r["callees"]["total"] == 0
    r = replies.call_path(g, M("run"), M("work")).first()
    assert r["found"] and r["hops"] == 1 and [x["symbol"] for x in r["nodes"]] == [M("run"), M("work")]
    assert not replies.call_path(g, M("work"), M("run")).first()["found"]
    assert replies.bases(g, M("run")).first()["note"]
    nodes, edges = replies.export(g, M("work"), 1, exclude_tests=True)
    assert nodes.count() == 2 and edges.count() == 1
    data = json.loads(graphjson.node_link(nodes, edges).first()["json"])
    assert len(data["nodes"]) == 2 and data["links"][0]["source_location"] == "L2"
    page = graphjson.viewer_html(json.dumps(data), "<t>")
    assert page.count("</script>") == 1 and "<title>&lt;t&gt;</title>" in page and json.dumps(data["nodes"])[1:-1].replace("</", "<\\/") in page
    over = graph(spark, [("calls", P + "N#parse(aaaaaa).", P + "N#parse(bbbbbb).", "f", 1)])
    r = replies.find(over, "parse").first()
    assert r["total"] == 2 and r["groups"] == 1 and r["results"][0]["overloads"] == 2


def test_store_round_trip(spark, tmp_path):
    g = graph(spark, [C("a", "b", "x.cpp", None), C("b", "c")], {M("a"): ("x.cpp", 3)}, [(T("W"), "a.cpp", 11, M("a")), (T("W"), "b.cpp", 7, None)])
    path = f"file://{tmp_path}/g"
    watch = store.ReloadingStore(spark, path)
    first = store.save(g, path, {"source_commit": "abc"})
    back = watch.get()
    assert back.meta["edge_count"] == "2" and back.meta["attributed_ref_count"] == "1" and back.meta["source_commit"] == "abc"
    assert sorted(map(str, back.callers(M("b")).collect())) == sorted(map(str, g.callers(M("b")).collect()))
    assert watch.get() is back
    store.save(g, path, {"schema_version": "99"})
    with pytest.raises(store.IncompatibleStoreError):
        watch.get()
    assert store.load(spark, path, first, by="src").edges.count() == 2
    store.save(g, path, {"schema_version": "?"})
    assert store.load(spark, path).edges.count() == 2
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"file://{tmp_path}/none")


def names(df):
    return {r["symbol"] for r in df.collect()}


def test_update(spark):
    g = graph(spark, [C("a", "old", "foo.cpp"), C("a", "shared", "foo.cpp"), C("c", "shared", "bar.cpp"), C("z", "y", "gone.cpp")], {M("a"): ("foo.cpp", 1), M("z"): ("gone.cpp", 2)}, [(T("W"), "foo.cpp", 5, None), (T("W"), "bar.cpp", 9, None)])
    part = occ(spark, ("foo.cpp", [D(M("a"), 7, 7, 30), U(M("new"), 21), U(T("W"), 21)]), ("baz.cpp", [D(M("e"), 1, 1, 9), U(M("a"), 3)]))
    docs = spark.createDataFrame([("foo.cpp",), ("baz.cpp",), ("empty.cpp",)], "doc string")
    out, stats = store.apply_update(g, derive.build(part, *no_info(spark)), docs, spark.createDataFrame([("gone.cpp",)], "doc string"))
    assert {r["dst"] for r in out.callees(M("a")).collect()} == {M("new")}
    assert {r["src"] for r in out.callers(M("a")).collect()} == {M("e")}
    assert names(out.symbols) == {M("a"), M("new"), M("e"), M("c"), M("shared"), T("W")}
    assert out.get_node(M("a")).first()["line"] == 7
    assert {(r["file"], r["line"]) for r in out.references(T("W")).collect()} == {("foo.cpp", 21), ("bar.cpp", 9)}
    assert (stats.files_changed, stats.edges_removed, stats.edges_added, stats.symbols_removed) == (4, 3, 2, 3)
    assert out.meta["edge_count"] == "3" and stats.node_count == 6
    kept = {r["symbol"]: r["id"] for r in g.symbols.collect()}
    assert all(kept[r["symbol"]] == r["id"] for r in out.symbols.collect() if r["symbol"] in kept)


def _size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_updates_of_a_store_write_what_changed(spark, tmp_path):
    """Random updates on top of each other, reopened each time, against apply_update in memory; each writes little, the old
    version stays readable, and compaction and vacuum change nothing."""
    rng = random.Random(6)
    path = f"file://{tmp_path}/g"
    syms = [M(f"f{k}") for k in range(40)]
    edges = [("calls", rng.choice(syms), rng.choice(syms), f"d{rng.randrange(200)}", k) for k in range(4000)] + [("inherits", T("A"), T("B"), None, None)]
    refs = [(rng.choice(syms), f"d{rng.randrange(200)}", k, rng.choice([None, *syms])) for k in range(3000)]
    g = graph(spark, edges, {s: (f"d{k}", k) for k, s in enumerate(syms)}, refs)
    store.save(g, path, {"commit": "x"})
    first = store.current_version(spark, path)
    whole = _size(tmp_path / "g")
    seen = lambda x: tuple(sorted(map(str, t.select(*sorted(t.columns)).collect())) for t in (x.symbols, x.files, x.edges, x.refs))
    at_first = seen(store.load(spark, path))
    for step in range(2):
        docs = [(f"d{rng.randrange(200)}", [D(M(f"f{rng.randrange(44)}"), 1, 1, 50), *(U(M(f"f{rng.randrange(50)}"), rng.randrange(60)) for _ in range(4))]) for _ in range(2)]
        gone = spark.createDataFrame([(f"d{rng.randrange(200)}",)], "doc string")
        built = derive.build(occ(spark, *docs), *no_info(spark), attribute_references=True)
        documents = spark.createDataFrame([(p,) for p, _ in docs] + [(f"empty{step}",)], "doc string")
        g, stats = store.apply_update(g, built, documents, gone)
        g = store.CodeGraph(*(t.checkpoint() for t in (g.files, g.symbols, g.edges, g.refs)), g.meta)
        before = _size(tmp_path / "g")
        assert store.update(spark, path, built, documents, gone, {"commit": f"y{step}"}) == stats
        assert _size(tmp_path / "g") - before < whole / 4
        back = store.load(spark, path, by=("src", "dst")[step % 2])
        assert seen(back) == seen(g) and back.meta["commit"] == f"y{step}"
        assert {k: v for k, v in back.meta.items() if k.endswith("_count") or k.startswith("has")} == {k: v for k, v in store.counts(back).items() if k != "schema_version"}
    assert seen(store.load(spark, path, first)) == at_first
    new = derive.references(occ(spark, *docs), True)
    enriched, k, n = store.enrich(back, new)
    want = seen(enriched)
    assert store.enrich_store(spark, path, new) == (k, n) and seen(store.load(spark, path)) == want
    assert store.vacuum(spark, path) == []  # all is still needed
    store.compact(spark, path)
    assert len(store.vacuum(spark, path)) == 4 and seen(store.load(spark, path)) == want


def test_names_index(spark, tmp_path):
    """Finds with an index are those of a scan, also after an update that adds and renames symbols."""
    path = f"file://{tmp_path}/g"
    made = [M("Foo#buildPipeline"), M("foo/build_Pipe"), T("Größe"), M("ab"), T("$anonymous_type_7"), M("x" * 300)]
    store.save(graph(spark, [("calls", a, b, "f.cpp", 1) for a in made for b in made[:2]]), path)
    store.index_names(spark, path)
    docs = spark.createDataFrame([("n.cpp",)], "doc string")
    info = spark.createDataFrame([(0, "n.cpp", 0, made[3], "Late name")], schema.SYMBOL_INFO)
    built = derive.build(occ(spark, ("n.cpp", [D(M("buildMore"), 1, 1, 9), U(made[3], 3)])), info, spark.createDataFrame([], schema.RELATIONSHIPS))
    for step in range(2):
        g = store.load(spark, path)
        plain = CodeGraph(g.files, g.symbols, g.edges)
        for k, q in enumerate(("BUILD", "build_Pipe", "Pipe build", "GRÖSSE", "ö", "ab build", "late", "nothing", "__ build")):
            fuzzy = k % 2 == step  # each query both ways, over the two steps
            assert names(g.find(q, fuzzy)) == names(plain.find(q, fuzzy)), q
        if not step:
            store.update(spark, path, built, docs)
    assert names(g.find("late", True)) == {made[3]} and M("buildMore") in names(g.find("build"))


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    store.save(graph(spark, [C("a", "b")]), path)
    parent = store.current_version(spark, path)
    docs = spark.createDataFrame([("f.cpp",)], "doc string")
    built = derive.build(occ(spark, ("f.cpp", [D(M("a"), 1, 1, 9), U(M("c"), 3)])), *no_info(spark))
    one, _ = store.stage(spark, path, parent, built, docs)
    two, _ = store.stage(spark, path, parent, built, docs)
    store.publish(spark, path, one, parent)
    with pytest.raises(store.ConcurrentUpdateError):
        store.publish(spark, path, two, parent)
    assert store.current_version(spark, path) == one
    store._write_text(spark, f"{path}/CURRENT", parent)  # as if the first writer had died on its last step
    with pytest.raises(store.ConcurrentUpdateError):
        store.publish(spark, path, two, parent)
    assert store.current_version(spark, path) == one


def test_enrich(spark):
    g = graph(spark, [], {M("render"): ("a.cpp", 5)}, [(T("W"), "a.cpp", 8, None), (T("W"), "a.cpp", 90, None)])
    new = derive.references(occ(spark, ("a.cpp", [D(M("render"), 5, 5, 20), U(T("W"), 8)])), True)
    out, k, n = store.enrich(g, new)
    assert (k, n) == (1, 2) and out.meta["has_attributed_refs"] == "true"
    assert {(r["line"], r["enclosing"]) for r in out.references(T("W")).collect()} == {(8, M("render")), (90, None)}
    with pytest.raises(ValueError):
        store.enrich(CodeGraph(g.files, g.symbols, g.edges), new)


def test_streamed_updates(spark, tmp_path):
    """Tables of documents that come in different batches and orders; hierarchy and names survive, the latest revision holds,
    a document without rows empties its file, and a batch run again changes nothing."""
    path, at = f"file://{tmp_path}/g", tmp_path / "in"
    store.save(graph(spark, [C("a", "old", "foo.cpp"), ("inherits", T("D"), T("B"), "foo.cpp", None), C("p", "q", "bar.cpp")], {M("a"): ("foo.cpp", 1)}), path)
    when = lambda k: datetime.datetime(2024, 1, 1, 0, k)

    def send(name, rows, s):
        spark.createDataFrame(rows, f"{s}, revision timestamp").coalesce(1).write.mode("append").parquet(f"{at}/{name}")

    def lines(k, *docs):
        send("occurrences", [(i, p, j, *x, when(k)) for i, (p, items) in enumerate(docs) for j, x in enumerate(items)], schema.OCCURRENCES)

    def follow():
        updates.follow(spark, f"file://{at}", path, f"file://{tmp_path}/ck").awaitTermination()

    for name, s in updates.TABLES.items():
        send(name, [], s)
    lines(0, ("foo.cpp", [D(M("a"), 1, 1, 9), U(M("stale"), 3)]))
    lines(1, ("foo.cpp", [D(M("a"), 1, 1, 9), U(M("new"), 3)]))
    send("documents", [(0, "foo.cpp", when(0)), (0, "foo.cpp", when(1)), (0, "bar.cpp", when(1))], schema.DOCUMENTS)
    follow()
    send("relationships", [(0, "foo.cpp", 0, T("D"), T("E"), True, when(1)), (0, "foo.cpp", 1, M("D#f"), M("E#f"), True, when(1))], schema.RELATIONSHIPS)
    send("symbol_info", [(0, "foo.cpp", 0, M("a"), "A!", when(1))], schema.SYMBOL_INFO)
    follow()
    assert store.load(spark, path).callees(M("a")).first()["dst"] in (M("old"), M("stale"))  # the revision isn't over yet
    send("documents", [(0, "later.cpp", when(9))], schema.DOCUMENTS)
    for _ in range(2):
        follow()
        g = store.load(spark, path)
        assert {r["dst"] for r in g.callees(M("a")).collect()} == {M("new")} and g.callers(M("q")).count() == 0
        assert names(g.bases(T("D"))) == {T("E")} and g.edges.filter("kind = 'implements'").count() == 1
        assert g.get_node(M("a")).first()["display_name"] == "A!"


def test_joins_of_a_batch(spark, tmp_path):
    """The rows of a batch seem small to plans however many there are: no join broadcasts them before they were measured."""
    for k in (100, 200):
        spark.range(50_000 if k == 100 else 1).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("doc"), F.timestamp_seconds(F.lit(k)).alias("revision")).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("doc string, revision timestamp").parquet(f"file://{tmp_path}/in").withWatermark("revision", "1 second").groupBy("doc", "revision").count()
    plans = []

    def one(batch, _):
        kept = batch.checkpoint()
        both = kept.join(kept.select("doc", F.col("count").alias("again")), "doc")
        n = both.count()
        plans.append((n, both.sparkSession.conf.get("spark.sql.adaptive.enabled"), both._jdf.queryExecution().sparkPlan().toString()))

    updates._start(rows, one, f"file://{tmp_path}/ck", True).awaitTermination()
    assert max(n for n, *_ in plans) >= 50_000
    assert all("BroadcastHashJoin" not in p and adaptive == "true" for _, adaptive, p in plans)


def test_streamed_indexes(spark, tmp_path):
    path, at = f"file://{tmp_path}/g", tmp_path / "in"
    at.mkdir()
    store.save(graph(spark, [C("a", "old", "foo.cpp"), ("inherits", T("D"), T("B"), "foo.cpp", None)], {M("a"): ("foo.cpp", 1)}), path)
    one = [{"symbol": M("a"), "symbol_roles": 1, "line": 1, "enc_start": 1, "enc_end": 9}, {"symbol": M("new"), "symbol_roles": 0, "line": 3, "enc_start": None, "enc_end": None}]
    info = [{"symbol": T("D"), "display_name": "Dee", "relationships": [{"symbol": T("E"), "is_implementation": True}]}]
    (at / "p.scip").write_bytes(scip.encoded("foo.cpp", one, info))
    for _ in range(2):
        updates.follow_indexes(spark, f"file://{at}", path, f"file://{tmp_path}/ck").awaitTermination()
        g = store.load(spark, path)
        assert {r["dst"] for r in g.callees(M("a")).collect()} == {M("new")} and names(g.bases(T("D"))) == {T("E")}
        assert g.get_node(T("D")).first()["display_name"] == "Dee"


def test_freshness(spark):
    assert freshness.staleness_verdict(10, 2, 1000) == {"changed": 12, "fraction": 0.012, "verdict": "update"}
    assert freshness.staleness_verdict(25, 0, 100)["verdict"] == "rebuild" and freshness.staleness_verdict(5, 0, 0)["fraction"] is None
    diff = spark.createDataFrame([("same", "changed"), ("more", "changed"), ("gone", "deleted"), ("plain", "changed")], "path string, state string")
    was = spark.createDataFrame([("same", "1"), ("more", "1"), ("back", "1"), ("gone", "1")], "path string, hash string")
    now = spark.createDataFrame([("same", "1"), ("more", "2"), ("back", "0")], "path string, hash string")
    got = {r["path"]: r["state"] for r in freshness.correct_changes(diff, was, now).collect()}
    assert got == {"more": "changed", "gone": "deleted", "plain": "changed", "back": "changed"}
    assert freshness.read_fingerprints({"dirty_fingerprints": '{"a": "1"}'}) == {"a": "1"} and freshness.read_fingerprints({"dirty_fingerprints": "?"}) == {}
    g = graph(spark, [C("a", "b", "x.cpp")])
    g.meta = {"has_references": "true"}
    got = replies.status(g, spark.createDataFrame([("x.cpp", "changed"), ("README.md", "changed")], "path string, state string"))
    assert got["usage_view"] == "file" and got["changed"] == 1 and got["verdict"] == "rebuild" and got["files"] == {"changed": ["x.cpp"]}


def test_index_batches_are_bounded():
    """A task makes Python objects of a bounded part of a batch, whatever the batch holds."""
    pa = pytest.importorskip("pyarrow")
    o = {"occ_ord": 0, "symbol": "cxx . . $ f().", "symbol_roles": 1, "line": 3, "enc_start": 3, "enc_end": 9}
    s = {"sym_ord": 0, "symbol": "cxx . . $ f().", "display_name": "f", "relationships": [{"rel_ord": 0, "symbol": "cxx . . $ g().", "is_implementation": True}]}
    docs = [{"doc": f"d{i}.cpp", "o": [o] * 500, "s": [s] if i % 2 else None} for i in range(300)]
    made = list(scip._encoded([pa.RecordBatch.from_pylist(docs)]))
    bodies = [bytes(x) + b"\x01" for b in made for x in b.column(0).to_pylist()]
    assert len(made) > 2 and all(b.nbytes < 2 * scip.HELD for b in made) and len(bodies) == 300
    back = list(scip._decoded([pa.RecordBatch.from_pydict({"ord": list(range(300)), "body": bodies})]))
    rows = [r for b in back for r in b.to_pylist()]
    assert len(back) > 2 and [r["doc_ord"] for r in rows] == list(range(300)) and [r["doc"] for r in rows] == [d["doc"] for d in docs]
    assert [len(r["occurrences"]) for r in rows] == [500] * 300 and rows[1]["occurrences"][2] == o | {"occ_ord": 2}
    assert [len(r["symbols"]) for r in rows] == [i % 2 for i in range(300)] and rows[1]["symbols"][0]["relationships"] == [{"symbol": "cxx . . $ g().", "is_implementation": True}]


def test_demo_calls_move_lines_once(spark, tmp_path):
    rows = [(1, 1, 10), (1, 1, 10), (1, 2, 20), (1, 2, 30), (1, 4, 40), (2, 3, 50), (None, 1, 60), (None, 2, 70)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        got = demo.calls(spark, str(tmp_path))
        assert sorted(tuple(r) for r in got.collect()) == [("calls", 10, k, demo.UNIT_BASE + 1, 1) for k in (20, 30)]
        first = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert first.count("Exchange hashpartitioning") == 2  # of one of which the other is a reuse; none behind the join


def test_changes_of_repeated_paths(spark):
    one = spark.range(100_000)
    diff = one.select(F.lit("a").alias("path"), F.lit("changed").alias("state"))
    was, now = (one.select(F.lit("a").alias("path"), (F.col("id") % k).cast("string").alias("hash")) for k in (2, 4))
    assert [tuple(r) for r in freshness.counted_changes(diff, was, now).collect()] == [("a", "changed", 100_000 * (100_000**2 - 2 * 50_000 * 25_000))]
    few = [df.limit(n) for df, n in ((diff, 3), (was, 4), (now, 500))]
    assert [tuple(r) for r in freshness.correct_changes(*few).groupBy("path", "state").count().collect()] == [("a", "changed", 3 * (4 * 500 - 2 * 2 * 125))]


def test_compdb(spark, tmp_path):
    files = ["/repo/src/acme/db/a.cpp", "/repo/src/acme/db/a_test.cpp", "/repo/src/acme/s/b.cpp", "/repo/src/third_party/x.c", "/repo/src/top.cpp"]
    p = tmp_path / "compile_commands.json"
    p.write_text(json.dumps([{"directory": "/b", "file": f} for f in files]))
    df = compdb.load_compdb(spark, str(p))
    got = compdb.summarize(df, "src/acme")
    assert (got["total"], got["tests"], got["common_prefix"], got["matched"], got["matched_tests"]) == (5, 1, "/repo/src", 3, 1)
    assert got["groups"][0] == ("acme/db", 2, 1) and ("top.cpp", 1, 0) in got["groups"]
    kept, n = compdb.filter_compdb(df, "acme", True)
    assert kept.count() == 2 and n == {"kept": 2, "total": 5, "dropped_tests": 1}
    with pytest.raises(compdb.PipelineError):
        compdb.filter_compdb(df, "nowhere")
    assert compdb.changed_units(df, ["s/b.cpp"]).count() == 1
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert compdb.find_compdb(str(tmp_path / "a" / "b")) == str(p.resolve())
    p.write_text("{}")
    with pytest.raises(ValueError):
        compdb.load_compdb(spark, str(p))


def test_large_compdb_is_a_folder_of_lists(spark, tmp_path):
    path = tmp_path / "build" / "compile_commands.json"
    entries = spark.range(2000).select(F.lit("/b").alias("directory"), F.format_string("/repo/%d.cpp", "id").alias("file"))
    compdb.write_compdb(entries, str(path), 20_000)
    lists = [json.loads(f.read_text()) for f in path.glob("part-*")]
    assert len(lists) > 2 and max(map(len, lists)) < 1000 and sum(map(len, lists)) == 2000
    (tmp_path / "src").mkdir()
    back = compdb.load_compdb(spark, compdb.find_compdb(str(tmp_path / "src")))
    assert back.select("file").distinct().count() == back.count() == 2000
    compdb.write_compdb(back.filter("file < '/repo/2'").select("directory", "file"), str(path))  # over what it is read from
    assert path.is_file() and len(json.loads(path.read_text())) == compdb.load_compdb(spark, str(path)).count() == 1112
    compdb.write_compdb(entries.limit(0), str(path))
    assert json.loads(path.read_text()) == []


def test_snippets(spark, tmp_path):
    (tmp_path / "a.cpp").write_text("\n".join(f"line {i}" for i in range(8)) + "\nvoid f(int a,\n  g(b)) {\n}\n")
    lines = snippets.source_lines(spark, str(tmp_path), ["a.cpp", "none.cpp"])
    sites = spark.createDataFrame([("a.cpp", 2), ("a.cpp", 4), ("b.cpp", 1)], "file string, line int")
    got = [(r["line1"], r["is_use"]) for r in snippets.merged_source(lines, sites, 2).collect()]
    assert got == [(1, False), (2, False), (3, True), (4, False), (5, True), (6, False), (7, False)]
    one = snippets.signatures(lines, spark.createDataFrame([("a.cpp", 8), ("a.cpp", 10)], "file string, line int"))
    assert {r["line"]: r["signature"] for r in one.collect()} == {8: "(int a, g(b))", 10: None}


def test_lines_of_a_tree(spark, tmp_path):
    root = tmp_path / "s r+c"
    (root / "in%20ner").mkdir(parents=True)
    (root / "a b.cpp").write_text("one\r\ntwo\n")
    (root / "in%20ner" / "c+d.h").write_text("\nthree")
    (root / "none.h").write_text("")
    every = {tuple(r) for r in snippets.tree_lines(spark, str(root)).collect()}
    assert every == {("a b.cpp", 0, "one"), ("a b.cpp", 1, "two"), ("in%20ner/c+d.h", 0, ""), ("in%20ner/c+d.h", 1, "three")}
    asked = spark.createDataFrame([("in%20ner/c+d.h",), ("in%20ner/c+d.h",), ("gone.h",), (None,)], "file string")
    assert {r["text"] for r in snippets.tree_lines(spark, f"file://{root}", asked).collect()} == {"", "three"}


def test_graph_json(spark, tmp_path):
    g = graph(spark, [C("a", "b")])
    nodes, edges = traverse.subgraph(g, M("a"))
    graphjson.save_json(nodes, edges, str(tmp_path / "j"))
    (tmp_path / "n.json").write_text(graphjson.node_link(*replies.export(g, M("a"), 1)).first()["json"])
    again = graphjson.load_node_link(spark, str(tmp_path / "n.json"))
    assert {tuple(r) for r in again["edges"].collect()} == {tuple(r) for r in replies.export(g, M("a"), 1)[1].select("kind", "src", "dst", "file", "line").collect()}
    assert {r["symbol"] for r in again["nodes"].collect()} == {r["symbol"] for r in replies.export(g, M("a"), 1)[0].collect()}
    back = graphjson.load_json(spark, str(tmp_path / "j"))
    assert back["nodes"].count() == 2 and back["edges"].first()["src"] == M("a")
