"""python -m stellate COMMAND STORE ...: builds and refreshes stores and prints replies as JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from stellate.operators import derive, freshness, store
from stellate.plans import replies
from stellate.sources import compdb, graphjson, scip


#: How many rows commands show at most.
_LIMITS = {"references": 50, "hotspots": 20, "explain": 10}


def _shown(out) -> str:
    rows = out.toJSON().collect() if isinstance(out, DataFrame) else [json.dumps(out)]  # replies are one row
    return "\n".join(rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stellate", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "update", "enrich"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("index", help="a SCIP index, or several by a pattern")
        c.add_argument("--no-references", action="store_true")
        c.add_argument("--attribute", action="store_true")
        c.add_argument("--deleted", nargs="*", default=[])
        if name != "enrich":
            c.add_argument("--source", help="a checkout, whose commit and changed files are recorded")
            c.add_argument("--scope-filter", help="the filter that the index was made with")
            c.add_argument("--scope-tests", choices=("include", "exclude"))
    c = sub.add_parser("compdb-summary")
    c.add_argument("file")
    c.add_argument("--filter")
    for name in ("find", "callers", "callees", "bases", "subtypes", "references", "impact", "explain", "export", "view", "path", "hotspots", "status"):
        c = sub.add_parser(name)
        c.add_argument("store")
        if name not in ("hotspots", "status"):
            c.add_argument("symbol")
        if name == "path":
            c.add_argument("target")
        c.add_argument("--limit", type=int, default=_LIMITS.get(name))
        if name in ("callers", "callees", "references", "impact", "explain", "hotspots", "export", "view"):
            c.add_argument("--tests", choices=("include", "exclude"))
        if name in ("find", "callers", "callees", "references", "impact", "hotspots"):
            c.add_argument("--include", dest="include_paths", action="append")
            c.add_argument("--exclude", dest="exclude_paths", action="append")
        if name in ("find", "callees", "explain"):
            c.add_argument("--hide-trivial", action="store_true", default=None)
        if name in ("callers", "callees", "bases", "subtypes", "impact", "explain", "hotspots"):
            c.add_argument("--full-symbols", action="store_true", default=None)
        if name in ("find", "references", "explain"):
            c.add_argument("--root")
        if name in ("references", "explain"):
            c.add_argument("--context", type=int)
        if name in ("impact", "export", "view"):
            c.add_argument("--depth", type=int)
        if name in ("impact", "hotspots"):
            c.add_argument("--kind")
        if name in ("export", "view"):
            c.add_argument("--mode", choices=("deps", "usage"), default="deps")
            c.add_argument("--direction")
    return p


def _provenance(spark: SparkSession, a: dict) -> dict[str, str]:
    """What a store records of its origin: the index's own head, and commit, changed files and scope as they are given."""
    head = scip.describe(spark, a["index"]) if not set("*?[{") & set(a["index"]) else {}
    commit = dirty = None
    if a["source"]:
        commit = freshness.git(a["source"], "rev-parse", "HEAD")
        changed = freshness.git_changes(a["source"], "HEAD") or []
        dirty = {path: freshness.git(a["source"], "hash-object", path) or "" for path, state in changed if state == "changed"}
    tests = None if a["scope_tests"] is None else a["scope_tests"] == "include"
    return store.provenance(head.get("project_root"), head.get("tool"), head.get("tool_version"), commit, dirty, a["scope_filter"], tests)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.getOrCreate()
    command = a.pop("command")
    if command == "compdb-summary":
        return compdb.format_summary(compdb.summarize(compdb.load_compdb(spark, a["file"]), a["filter"]))
    if command in ("build", "update", "enrich"):
        got = scip.read_index(spark, a["index"])
        parts = (got["occurrences"], got["symbol_info"], got["relationships"])
        if command == "build":
            built = derive.build(*parts, include_references=not a["no_references"], attribute_references=a["attribute"])
            return store.save(store.intern(built), a["store"], _provenance(spark, a))
        if command == "enrich":
            k, n = store.enrich_store(spark, a["store"], derive.references(got["occurrences"], True))
            return json.dumps({"attributed": k, "references": n})
        deleted = spark.createDataFrame([(d,) for d in a["deleted"]], "doc string")
        said = vars(store.update(spark, a["store"], derive.build(*parts, attribute_references=a["attribute"]), got["documents"].select("doc"), deleted, _provenance(spark, a)))
        return json.dumps(said)
    graph = store.load(spark, a.pop("store"))
    tests, mode = a.pop("tests", None), a.pop("mode", None)
    options = {k: v for k, v in a.items() if v is not None} | ({"exclude_tests": tests == "exclude"} if tests else {})
    if command == "status":
        return _shown(replies.status(graph))
    if command == "hotspots":
        return _shown(replies.hotspots(graph, **options))
    symbol = options.pop("symbol")
    if command == "path":
        return _shown(replies.call_path(graph, symbol, options["target"]))
    if command in ("explain", "export", "view"):
        known, other = replies.ambiguity(graph, symbol)
        if known is None:
            return _shown(other)
        symbol = known
    if command in ("export", "view"):
        options.pop("limit", None)
        if mode == "usage":
            return _shown(replies.usage(graph, symbol))
        found = graphjson.node_link(*replies.export(graph, symbol, **options)).first()["json"]
        return graphjson.viewer_html(found, symbol) if command == "view" else found
    return _shown(getattr(replies, command)(graph, symbol, **options))


def run() -> None:
    print(main())


if __name__ == "__main__":
    run()
