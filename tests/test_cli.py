import json

from pyspark.sql import functions as F
from test_functions import field, index, number

from stellate import __main__ as cli
from stellate.functions import versions
from stellate.operators import store
from stellate.sources import graphjson


def test_commands(spark, tmp_path):
    packed = lambda *v: b"".join(map(number, v))
    use = field(2, "base().") + field(1, packed(9, 0, 1))
    (tmp_path / "i.scip").write_bytes(index() + field(2, field(1, "src/y.cpp") + field(2, field(2, "y().") + field(3, 1) + field(1, packed(3, 0, 9)) + field(7, packed(3, 0, 30, 1))) + field(2, use)))
    at = f"file://{tmp_path}/.stellate/g"
    run = lambda *argv: cli.main(list(argv), spark)
    run("build", at, str(tmp_path / "i.scip"))
    one = json.loads(run("callers", at, "base"))
    assert one["total"] == 1 and one["results"][0] == {"symbol": "y().", "file": "src/y.cpp", "line": 10}
    assert json.loads(run("callees", at, "y().", "--hide-trivial", "--tests", "include"))["total"] == 1
    assert json.loads(run("find", at, "a"))["total"] == 2
    assert json.loads(run("references", at, "c#"))["results"][0]["line"] == 301
    assert json.loads(run("path", at, "y().", "base()."))["hops"] == 1
    assert json.loads(run("impact", at, "base().", "--depth", "1"))["total"] == 1
    assert json.loads(run("hotspots", at, "--kind", "fan_out", "--limit", "1"))["truncated"] in (True, False)
    assert cli.parser().parse_args(["references", at, "c#"]).limit == 50 and cli.parser().parse_args(["hotspots", at]).limit == 20
    page = spark.createDataFrame([(run("view", at, "y().", "--depth", "1"),)], "page string").select(graphjson.viewer_graph(F.col("page")))
    assert json.loads(page.first()[0]) == json.loads(run("export", at, "y().", "--depth", "1"))
    assert json.loads(run("status", at))["usage_view"] == "file"
    assert json.loads(run("explain", at, "y()."))["callees"]["total"] == 1
    assert len(json.loads(run("export", at, "y().", "--depth", "1"))["links"]) == 1
    assert "y()." in run("view", at, "y().", "--depth", "1") and run("view", at, "y().").startswith("<!DOCTYPE html>")
    run("build", f"{at}2", str(tmp_path / "i.scip"), "--source", str(tmp_path), "--scope-filter", "src", "--scope-tests", "exclude")
    meta = store.load(spark, f"{at}2").meta
    assert meta["project_root"] == "file:///repo" and meta["index_tool"] == "tool" and meta["index_filter"] == "src" and meta["index_tests"] == "excluded"
    assert json.loads(run("enrich", at, str(tmp_path / "i.scip")))["attributed"] > 0
    assert json.loads(run("status", at))["usage_view"] == "symbol"
    (tmp_path / "p.scip").write_bytes(field(2, field(1, "src/y.cpp")))
    assert json.loads(run("update", at, str(tmp_path / "p.scip")))["edges_removed"] == 1
    assert json.loads(run("callers", at, "base"))["total"] == 0
    assert store.discover(str(tmp_path)) == str((tmp_path / ".stellate" / "g").resolve())


def test_sources_in_replies(spark, tmp_path):
    from test_graph import C, M, T, graph

    from stellate.plans import replies

    (tmp_path / "a.cpp").write_text("one\ntwo\nvoid run(int x)\n{\n}\n")
    g = graph(spark, [C("run", "work", "a.cpp", 3)], {M("run"): ("a.cpp", 2)}, [(T("W"), "a.cpp", 1, None), (T("W"), "a.cpp", 3, None)])
    r = replies.references(g, T("W"), root=str(tmp_path), context=1).first()
    assert [(x["line1"], x["is_use"]) for x in r["source"][0]["lines"]] == [(1, False), (2, True), (3, False), (4, True), (5, False)]
    r = replies.explain(g, M("run"), root=str(tmp_path), context=0).first()
    assert r["source"][0]["lines"][0]["text"] == "void run(int x)"
    r = replies.find(g, "run", root=str(tmp_path)).first()
    assert r["results"][0]["signatures"][0]["signature"] == "(int x)"


def test_registry(tmp_path):
    p = tmp_path / "v.json"
    assert versions.read_registry(str(p)) is None
    p.write_text('{"latest": "1.0"}')
    assert versions.read_registry(str(p)) == {"latest": "1.0"} and versions.read_registry(str(p), -1) is None
    p.write_text("[")
    assert versions.read_registry(str(p)) is None
    got = versions.indexer_advice("0.3.2", "0.4.0", "v0.4.0", "reindex")
    assert got["reindex"] and got["installed_status"] == "ok"
    assert not versions.indexer_advice("0.3.2", "0.3.2", "0.4.0")["reindex"] and versions.indexer_advice("0.3.2", None, "0.4.0")["installed_status"] == "unknown"
    assert versions.indexer_advice("0.3.2", "0.3.2", None) == {"checked": False}
