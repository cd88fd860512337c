"""The stored graph: interned tables in versioned folders, and their maintenance.

A store is a folder with a folder for each version and a file CURRENT that names the one to read; a version is written whole
before CURRENT moves to it, so that readers never see half of an update and a job that dies leaves the old version in place.
Edges are laid out twice, sorted by either end, so that a filter on an end prunes row groups.

A version holds only what it changed. Its MANIFEST lists for each table the folders that make it up, its own and those of
earlier versions, each with a number. An update writes rows of the changed files alone, and which files these are: a row of an
edge or reference holds if its file wasn't replaced under a later number, a row of a symbol if no later one has its id.
Readers join the few replaced files and symbols away. When there are many, `compact` writes a version of whole tables;
`vacuum` removes the folders that no kept version lists.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate import __version__, schema
from stellate.operators.names import POSTINGS, postings
from stellate.plans.graph import CodeGraph
from stellate.session import cut

SMALL = 1_000_000  # replaced ids that are broadcast at most
SEGMENTS, CHANGED_SHARE = 16, 0.25  # folders of a table, and part of its rows that were replaced, up to which updates go on top


class ConcurrentUpdateError(RuntimeError):
    """Another writer moved the store on: load it and update again."""


class IncompatibleStoreError(RuntimeError):
    """The store was written in a newer format."""


@dataclass
class UpdateStats:
    files_changed: int
    edges_removed: int
    edges_added: int
    symbols_removed: int
    node_count: int
    edge_count: int


def dense_ids(keys: DataFrame, key: str, order: str, base: int = 0) -> DataFrame:
    """(key, id): consecutive numbers from base + 1 in the order of `order`, then key, without one task for all rows:
    rows are ranged over partitions, counted there, and numbered behind the partitions before."""
    ranged = cut(keys.select(key, order).repartitionByRange(order, key).sortWithinPartitions(order, key).withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("p").orderBy(order, key))
    return ranged.withColumn("k", local).join(F.broadcast(before), "p").select(key, (F.col("before") + F.col("k") + base).cast("long").alias("id"))


def intern(built: dict[str, DataFrame]) -> CodeGraph:
    """The named tables of derive.build as a CodeGraph with ids, files and symbols in string order."""
    nodes, edges, refs = built["nodes"], built["edges"], built["refs"]
    paths = nodes.select("file").union(edges.select("file")).union(refs.select("file")).filter("file is not null").distinct()
    files = cut(dense_ids(paths.select(F.col("file").alias("path"), F.lit(0).alias("o")), "path", "o"))
    fid = files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    ids = cut(dense_ids(nodes.select("symbol", F.lit(0).alias("o")), "symbol", "o"))
    symbols = nodes.join(ids, "symbol").join(fid, "file", "left").select("id", "symbol", "display_name", "file_id", "line")

    def end(df, name, out):
        return df.join(ids.select(F.col("id").alias(out), F.col("symbol").alias(name)), name, "left")

    e = end(end(edges, "src", "src_id"), "dst", "dst_id").join(fid, "file", "left").select("kind", "src_id", "dst_id", "file_id", "line")
    r = end(end(refs, "symbol", "symbol_id"), "enclosing", "enclosing_id").join(fid, "file", "left").select("symbol_id", "file_id", "line", "enclosing_id")
    return CodeGraph(files.select("id", "path"), symbols, e, r, spans=_span_ids(built, ids, fid))


def _span_ids(built: dict[str, DataFrame], ids: DataFrame, fid: DataFrame) -> DataFrame | None:
    if "spans" not in built:
        return None
    named = built["spans"].join(ids.select(F.col("id").alias("symbol_id"), "symbol"), "symbol").join(fid, "file")
    return named.select(*(c.split()[0] for c in schema.SPANS.split(", ")))


def counts(graph: CodeGraph) -> dict[str, str]:
    """Counts and flags for meta."""
    out = {"schema_version": str(schema.SCHEMA_VERSION), "node_count": str(graph.symbols.count()), "edge_count": str(graph.edges.count())}
    if graph.refs is not None:
        n, k = graph.refs.agg(F.count(F.lit(1)), F.count("enclosing_id")).first()
        if n:
            out |= {"has_references": "true", "ref_count": str(n)}
        if k:
            out |= {"has_attributed_refs": "true", "attributed_ref_count": str(k)}
    return out


def provenance(project_root: str | None = None, tool: str | None = None, tool_version: str | None = None, commit: str | None = None, dirty: dict[str, str] | None = None, index_filter: str | None = None, index_tests: bool | None = None, variant: str | None = None) -> dict[str, str]:
    """Where a graph comes from. Scope keys only where they are given; an empty filter is recorded."""
    out = {"built_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "built_with": __version__}
    for key, value in (("project_root", project_root), ("index_tool", tool), ("index_tool_version", tool_version), ("index_tool_variant", variant), ("source_commit", commit)):
        if value:
            out[key] = value
    if dirty is not None:
        out |= {"source_dirty": str(bool(dirty)).lower(), "dirty_fingerprints": json.dumps(dirty, sort_keys=True)}
    if index_filter is not None:
        out["index_filter"] = index_filter
    if index_tests is not None:
        out["index_tests"] = "included" if index_tests else "excluded"
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file at once: readers see the old text or the new one."""
    fs, p = _fs(spark, path)
    new = f"{path}.{uuid.uuid4().hex}.new"
    out = fs.create(_fs(spark, new)[1], False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(_fs(spark, new)[1]), fs.makeQualified(p), options)


TABLES = ("files", "symbols", "edges_by_src", "edges_by_dst", "refs", "spans")


def _new_version() -> str:
    return f"v-{datetime.datetime.now(datetime.UTC):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"


def _write_edges(edges: DataFrame, at: str, small: bool = False) -> None:
    e = edges.select("kind", "src_id", "dst_id", "file_id", "line")
    for end in ("src", "dst"):
        ranged = e.coalesce(1) if small else e.repartitionByRange(f"{end}_id")
        ranged.sortWithinPartitions(f"{end}_id").write.partitionBy("kind").parquet(f"{at}/edges_by_{end}")


def _write_refs(refs: DataFrame, at: str, small: bool = False) -> None:
    r = refs.select("symbol_id", "file_id", "line", "enclosing_id")
    (r.coalesce(1) if small else r.repartitionByRange("symbol_id")).sortWithinPartitions("symbol_id", "file_id", "line").write.parquet(f"{at}/refs")


def _write_symbols(symbols: DataFrame, at: str, small: bool = False) -> None:
    s = symbols.select("id", "symbol", "display_name", "file_id", "line", *(["gone"] if "gone" in symbols.columns else []))
    (s.coalesce(1) if small else s.repartitionByRange("symbol")).sortWithinPartitions("symbol").write.parquet(f"{at}/symbols")


def _write_spans(spans: DataFrame, at: str, small: bool = False) -> None:
    (spans.coalesce(1) if small else spans.repartitionByRange("file_id", "bucket")).sortWithinPartitions("file_id", "bucket").write.parquet(f"{at}/spans")


def _write_names(symbols: DataFrame, at: str, small: bool = False) -> None:
    p = postings(symbols)
    (p.coalesce(1) if small else p.repartitionByRange("gram", "part")).sortWithinPartitions("gram", "part").write.parquet(f"{at}/names")


def _write_head(spark: SparkSession, path: str, version: str, manifest: dict, meta: dict[str, str]) -> None:
    at = f"{path.rstrip('/')}/{version}"
    spark.createDataFrame(sorted(meta.items()), schema.META).coalesce(1).write.parquet(f"{at}/meta")
    _write_text(spark, f"{at}/MANIFEST", json.dumps(manifest))


def publish(spark: SparkSession, path: str, version: str, parent: str | None = None) -> str:
    """Makes a whole version the current one; with a parent only if no other version follows that."""
    if parent is not None:
        claim = f"{path.rstrip('/')}/{parent}/NEXT"
        fs, p = _fs(spark, claim)
        try:
            out = fs.create(p, False)  # one writer only can make it
            out.write(bytearray(version.encode()))
            out.close()
        except Exception as e:
            other = (_read_text(spark, claim) or "").strip()
            if other and current_version(spark, path) == parent and fs.exists(_fs(spark, f"{path.rstrip('/')}/{other}/MANIFEST")[1]):
                _write_text(spark, f"{path.rstrip('/')}/CURRENT", other)  # its writer died on the last step
            raise ConcurrentUpdateError(f"version {other or '?'} follows {parent}") from e
    _write_text(spark, f"{path.rstrip('/')}/CURRENT", version)
    return version


def save(graph: CodeGraph, path: str, meta: dict[str, str] | None = None, parent: str | None = None) -> str:
    """Write a new version of whole tables and make it the current one, with a parent only as publish does. Counts in `meta`
    win over counted ones."""
    spark = graph.symbols.sparkSession
    version = _new_version()
    at = f"{path.rstrip('/')}/{version}"
    edges = cut(graph.edges.select("kind", "src_id", "dst_id", "file_id", "line"))  # laid out twice and counted
    graph.files.select("id", "path").write.parquet(f"{at}/files")
    _write_symbols(graph.symbols, at)
    _write_edges(edges, at)
    if graph.refs is not None:
        _write_refs(graph.refs, at)
    if graph.spans is not None:
        _write_spans(graph.spans, at)
    tables = {t: [[version, 0]] for t in TABLES if t not in ("refs", "spans") or getattr(graph, t) is not None}
    manifest = {"number": 0, "tables": tables, "replaced": [], "replaced_rows": 0, "changed_symbols": 0}
    written = _tables(spark, path, manifest)
    written.edges = edges
    _write_head(spark, path, version, manifest, counts(written) | (meta or {}))
    return publish(spark, path, version, parent)


_STORED = {"files": schema.FILES, "symbols": schema.SYMBOLS + ", gone boolean", "edges_by_src": "src_id long, dst_id long, file_id long, line int, kind string", "edges_by_dst": "src_id long, dst_id long, file_id long, line int, kind string", "refs": schema.REFS, "replaced": "file_id long", "names": POSTINGS, "spans": schema.SPANS}


def _parts(spark: SparkSession, path: str, manifest: dict, table: str) -> list[tuple[int, DataFrame]]:
    found = manifest["replaced"] if table == "replaced" else manifest["tables"].get(table, [])
    return [(n, spark.read.schema(_STORED[table]).parquet(f"{path.rstrip('/')}/{v}/{table}")) for v, n in found]


def _stacked(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("_n", F.lit(n)) for n, df in parts])


def _without(rows: DataFrame, later: DataFrame, key: str, small: bool) -> DataFrame:
    """Rows that no later row (key, number) replaces."""
    last = later.groupBy(F.col(key).alias("_key")).agg(F.max("_n").alias("_last"))
    last = F.broadcast(last) if small else last
    return rows.join(last, (F.col(key) == F.col("_key")) & (F.col("_n") < F.col("_last")), "left_anti")


def _table(spark: SparkSession, path: str, manifest: dict, table: str) -> DataFrame | None:
    parts = _parts(spark, path, manifest, table)
    if not parts:
        return None
    if table in ("files", "names"):
        return _stacked(parts).drop("_n")
    if table == "symbols":
        if len(parts) == 1:
            return parts[0][1].drop("gone")
        rows = _without(_stacked(parts), _stacked(parts[1:]).select("id", "_n"), "id", manifest["changed_symbols"] <= SMALL)
        return rows.filter(~F.coalesce("gone", F.lit(False))).drop("gone", "_n")
    least = parts[0][0]
    later = [(n, df) for n, df in _parts(spark, path, manifest, "replaced") if n > least]
    rows = _stacked(parts)
    if later:
        rows = _without(rows, _stacked(later), "file_id", manifest["replaced_rows"] <= SMALL)
    return rows.drop("_n")


def _tables(spark: SparkSession, path: str, manifest: dict, by: str = "dst") -> CodeGraph:
    files, symbols, edges, refs = (_table(spark, path, manifest, t) for t in ("files", "symbols", f"edges_by_{by}", "refs"))
    return CodeGraph(files, symbols, edges.select("kind", "src_id", "dst_id", "file_id", "line"), refs)


def current_version(spark: SparkSession, path: str) -> str | None:
    text = _read_text(spark, f"{path.rstrip('/')}/CURRENT")
    return text.strip() if text else None


def _manifest(spark: SparkSession, path: str, version: str) -> dict:
    """A version's manifest; one without a manifest is made of its own folders."""
    text = _read_text(spark, f"{path.rstrip('/')}/{version}/MANIFEST")
    if text:
        return json.loads(text)
    fs, p = _fs(spark, f"{path.rstrip('/')}/{version}/refs")
    return {"number": 0, "tables": {t: [[version, 0]] for t in TABLES if t != "spans" and (t != "refs" or fs.exists(p))}, "replaced": [], "replaced_rows": 0, "changed_symbols": 0}


def load(spark: SparkSession, path: str, version: str | None = None, by: str = "dst") -> CodeGraph:
    """The current (or named) version, with edges sorted by dst or src. A newer format is refused; a missing or
    unreadable format number is taken for an old one."""
    version = version or current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no store at {path}")
    meta = {r["key"]: r["value"] for r in spark.read.schema(schema.META).parquet(f"{path.rstrip('/')}/{version}/meta").collect()}
    try:
        number = int(meta.get("schema_version", "1"))
    except ValueError:
        number = 1
    if number > schema.SCHEMA_VERSION:
        raise IncompatibleStoreError(f"the store has format {number}; this version reads {schema.SCHEMA_VERSION} and older ones")
    manifest = _manifest(spark, path, version)
    graph = _tables(spark, path, manifest, by)
    graph.meta, graph.names, graph.spans = meta, *(_table(spark, path, manifest, t) for t in ("names", "spans"))
    return graph


def discover(start: str = ".") -> str | None:
    """The newest store in a .stellate folder of the folder or of one above it; a driver-side search."""
    here = Path(start.removeprefix("file://")).resolve()
    for d in (here, *here.parents):
        found = sorted((d / ".stellate").glob("*/CURRENT"), key=lambda p: p.stat().st_mtime)
        if found:
            return str(found[-1].parent)
    return None


class ReloadingStore:
    """Gives the graph of the current version, read anew when that has moved."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version, self.graph = spark, path, None, None

    def get(self) -> CodeGraph:
        now = current_version(self.spark, self.path)
        if now != self.version or self.graph is None:
            self.graph, self.version = load(self.spark, self.path, now), now
        return self.graph


def indexed_file_count(graph: CodeGraph) -> int:
    return graph.files.count()


def _ids_of(known: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, id) of the wanted keys, those of them that `known` (id, key, ...) lacks): new ids are past the largest."""
    wanted = cut(wanted.filter(F.col(key).isNotNull()).select(key).distinct())
    found = cut(known.select("id", key).join(wanted, key, "left_semi"))
    missing = wanted.join(found, key, "left_anti").withColumn("o", F.lit(0))
    if missing.isEmpty():
        return found.select(key, "id"), found.limit(0).select(key, "id")
    base = known.agg(F.max("id")).first()[0] or 0
    new = cut(dense_ids(missing, key, "o", base).select(key, "id"))
    return found.select(key, "id").unionByName(new), new


@dataclass
class Delta:
    """What an update changes: the replaced files (file_id), new files, symbols with their new rows or `gone`, added edges,
    references and bodies, and what counts become."""

    replaced: DataFrame
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    refs: DataFrame
    spans: DataFrame
    meta: dict[str, str]
    stats: UpdateStats


def delta(graph: CodeGraph, built: dict[str, DataFrame], documents: DataFrame, deleted: DataFrame | None = None) -> Delta:
    """What apply_update changes in the graph. Only rows of changed files, and symbols that they touch, are shuffled or
    written; of the rest id columns are read."""
    spark = graph.edges.sparkSession
    changed = documents.select(F.col("doc").alias("path"))
    if deleted is not None:
        changed = changed.union(deleted.select(F.col("doc").alias("path")))
    changed = cut(changed.distinct())
    hit = cut(graph.files.join(changed, "path", "left_semi").select(F.col("id").alias("file_id")))
    n_changed = changed.count()
    near = F.broadcast if n_changed <= SMALL else (lambda df: df)
    refs = graph.refs if graph.refs is not None else spark.createDataFrame([], schema.REFS)
    gone = cut(graph.edges.join(near(hit), "file_id", "left_semi").select("src_id", "dst_id"))
    gone_refs = cut(refs.join(near(hit), "file_id", "left_semi").select("symbol_id", "enclosing_id"))
    nodes, edges, new_refs = built["nodes"], built["edges"], built["refs"]
    fids, new_files = _ids_of(graph.files, "path", nodes.select(F.col("file").alias("path")).union(edges.select("file")).union(new_refs.select("file")).union(documents.select("doc")))
    ids, new_ids = _ids_of(graph.symbols, "symbol", nodes.select("symbol"))
    n_ids = ids.count()
    fid = fids.select(F.col("id").alias("file_id"), F.col("path").alias("file"))

    def end(df, name, out):
        return df.join(ids.select(F.col("id").alias(out), F.col("symbol").alias(name)), name, "left")

    added = cut(end(end(edges, "src", "src_id"), "dst", "dst_id").join(fid, "file", "left").select("kind", "src_id", "dst_id", "file_id", "line"))
    added_refs = cut(end(end(new_refs, "symbol", "symbol_id"), "enclosing", "enclosing_id").join(fid, "file", "left").select("symbol_id", "file_id", "line", "enclosing_id"))
    there = graph.symbols.join(near(hit), "file_id", "left_semi").select("id")  # defined in a changed file
    touched = cut(there.union(gone.select("src_id")).union(gone.select("dst_id")).union(gone_refs.select("symbol_id")).distinct())
    wanted = ids.select("id").union(touched).distinct()
    old = graph.symbols.join(F.broadcast(wanted) if touched.count() + n_ids <= SMALL else wanted, "id", "left_semi").join(hit.withColumn("hit", F.lit(True)), "file_id", "left")
    old = old.select("id", F.col("symbol").alias("old_symbol"), F.col("display_name").alias("old_name"), F.when(F.col("hit").isNull(), F.col("file_id")).alias("old_file"), F.when(F.col("hit").isNull(), F.col("line")).alias("old_line"))
    fresh = end(nodes, "symbol", "id").join(fid, "file", "left").select("id", F.col("symbol").alias("new_symbol"), F.col("display_name").alias("new_name"), F.col("file_id").alias("new_file"), F.col("line").alias("new_line"))
    merged = cut(old.join(fresh, "id", "full").select("id", F.coalesce("old_symbol", "new_symbol").alias("symbol"), F.coalesce(F.nullif("new_name", F.lit("")), "old_name").alias("display_name"), F.coalesce("new_file", "old_file").alias("file_id"), F.coalesce("new_line", "old_line").alias("line")))
    bare = cut(merged.filter("file_id is null").select("id").join(touched, "id", "left_semi"))
    few = near(bare) if bare.count() <= SMALL else bare
    kept_edges = graph.edges.join(near(hit), "file_id", "left_anti")

    def uses(df, column):
        return df.select(F.col(column).alias("id")).join(few, "id", "left_semi")

    used = uses(kept_edges, "src_id").union(uses(kept_edges, "dst_id")).union(uses(refs.join(near(hit), "file_id", "left_anti"), "symbol_id"))
    used = used.union(uses(added, "src_id")).union(uses(added, "dst_id")).union(uses(added_refs, "symbol_id")).distinct()
    orphans = bare.join(used, "id", "left_anti").withColumn("gone", F.lit(True))
    rows = cut(merged.join(orphans, "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    before = graph.meta if {"node_count", "edge_count"} <= set(graph.meta or {}) else counts(graph)
    n_gone, n_added, n_orphans = gone.count(), added.count(), rows.filter("gone").count()
    node_count = int(before["node_count"]) + new_ids.count() - n_orphans
    edge_count = int(before["edge_count"]) - n_gone + n_added
    meta = dict(graph.meta or {}) | {"schema_version": str(schema.SCHEMA_VERSION), "node_count": str(node_count), "edge_count": str(edge_count)}
    if graph.refs is not None:
        lost, got = (df.agg(F.count(F.lit(1)), F.count("enclosing_id")).first() for df in (gone_refs, added_refs))
        for key, flag, k in (("ref_count", "has_references", 0), ("attributed_ref_count", "has_attributed_refs", 1)):
            n = int(before.get(key, 0)) - lost[k] + got[k]
            meta = {x: v for x, v in meta.items() if x not in (key, flag)} | ({key: str(n), flag: "true"} if n else {})
    spans = _span_ids(built, ids, fid) if graph.spans is not None else None
    spans = spark.createDataFrame([], schema.SPANS) if spans is None else cut(spans)
    return Delta(hit, new_files.select("id", "path"), rows, added, added_refs, spans, meta, UpdateStats(n_changed, n_gone, n_added, n_orphans, node_count, edge_count))


def apply_update(graph: CodeGraph, built: dict[str, DataFrame], documents: DataFrame, deleted: DataFrame | None = None) -> tuple[CodeGraph, UpdateStats]:
    """Replace what the changed files hold: `documents` (doc) lists the files of a partial index, `built` what was
    derived from it, `deleted` (doc) files that are gone.

    Edges and references of changed files go and the new ones come; sites in changed files are forgotten and new sites
    win over old ones, new names over old ones if they aren't empty; symbols that this touched, without a site, an edge
    or a reference, are dropped. Ids stay; new ones follow the largest.
    """
    d = delta(graph, built, documents, deleted)
    files = graph.files.select("id", "path").unionByName(d.files)
    symbols = graph.symbols.select("id", "symbol", "display_name", "file_id", "line").join(d.symbols.select("id"), "id", "left_anti").unionByName(d.symbols.filter("not gone").drop("gone"))
    edges = graph.edges.join(d.replaced, "file_id", "left_anti").select("kind", "src_id", "dst_id", "file_id", "line").unionByName(d.edges)
    refs = None
    if graph.refs is not None:
        refs = graph.refs.join(d.replaced, "file_id", "left_anti").select("symbol_id", "file_id", "line", "enclosing_id").unionByName(d.refs)
    spans = None if graph.spans is None else graph.spans.join(d.replaced, "file_id", "left_anti").select(*d.spans.columns).unionByName(d.spans)
    return CodeGraph(files, symbols, edges, refs, d.meta, spans=spans), d.stats


def stage(spark: SparkSession, path: str, onto: str, built: dict[str, DataFrame], documents: DataFrame, deleted: DataFrame | None = None, meta: dict[str, str] | None = None) -> tuple[str, UpdateStats]:
    """Writes a version on top of `onto` that holds what an update changes and nothing else; `publish` makes it current."""
    graph, old = load(spark, path, onto), _manifest(spark, path, onto)
    d = delta(graph, built, documents, deleted)
    version, n = _new_version(), old["number"] + 1
    at = f"{path.rstrip('/')}/{version}"
    rows = {"files": d.files, "symbols": d.symbols, "edges_by_src": d.edges, "refs": d.refs, "spans": d.spans, "replaced": d.replaced}
    size = {t: df.count() for t, df in rows.items()}
    small = {t: k <= SMALL for t, k in size.items()}
    tables = {t: list(x) for t, x in old["tables"].items()}
    if size["files"]:
        (d.files.coalesce(1) if small["files"] else d.files).write.parquet(f"{at}/files")
    if size["symbols"]:
        _write_symbols(d.symbols, at, small["symbols"])
    if size["edges_by_src"]:
        _write_edges(d.edges, at, small["edges_by_src"])
    if graph.refs is not None and size["refs"]:
        _write_refs(d.refs, at, small["refs"])
    if size["replaced"]:
        (d.replaced.coalesce(1) if small["replaced"] else d.replaced).write.parquet(f"{at}/replaced")
    if "spans" in tables and size["spans"]:
        _write_spans(d.spans, at, small["spans"])
    if "names" in tables and size["symbols"]:
        _write_names(d.symbols.filter("not gone"), at, small["symbols"])
    for t in tables:
        if size[{"edges_by_dst": "edges_by_src", "names": "symbols"}.get(t, t)]:
            tables[t].append([version, n])
    replaced = old["replaced"] + ([[version, n]] if size["replaced"] else [])
    _write_head(spark, path, version, {"number": n, "tables": tables, "replaced": replaced, "replaced_rows": old["replaced_rows"] + size["replaced"], "changed_symbols": old["changed_symbols"] + size["symbols"]}, d.meta | (meta or {}))
    return version, d.stats


def update(spark: SparkSession, path: str, built: dict[str, DataFrame], documents: DataFrame, deleted: DataFrame | None = None, meta: dict[str, str] | None = None) -> UpdateStats:
    """As apply_update on the store at `path`. After many updates, or when much of a table was replaced, a version of whole tables
    follows. A writer that another one overtook gets ConcurrentUpdateError."""
    parent = current_version(spark, path)
    version, stats = stage(spark, path, parent, built, documents, deleted, meta)
    publish(spark, path, version, parent)
    m = _manifest(spark, path, version)
    if max(map(len, m["tables"].values())) > SEGMENTS or max(m["changed_symbols"], m["replaced_rows"]) > CHANGED_SHARE * stats.node_count + 1000:
        compact(spark, path)
    return stats


def compact(spark: SparkSession, path: str) -> str:
    """A version of whole tables with the rows of the current one."""
    parent = current_version(spark, path)
    graph = load(spark, path, parent)
    version = save(graph, path, graph.meta, parent)
    return version if graph.names is None else index_names(spark, path)


def index_names(spark: SparkSession, path: str) -> str:
    """A version with an index of names, which find and resolve use from then on and updates keep up."""
    parent = current_version(spark, path)
    old = _manifest(spark, path, parent)
    graph = load(spark, path, parent)
    version, number = _new_version(), old["number"] + 1
    _write_names(graph.symbols, f"{path.rstrip('/')}/{version}")
    _write_head(spark, path, version, old | {"number": number, "tables": old["tables"] | {"names": [[version, number]]}}, graph.meta)
    return publish(spark, path, version, parent)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes the folders that the current version and the `keep - 1` newest before it don't need; gives their names. For
    when no reader of older versions is left."""
    fs, p = _fs(spark, path)
    now = current_version(spark, path)
    found = sorted((x.getModificationTime(), x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().startswith("v-"))
    done = [v for _, v in found if fs.exists(_fs(spark, f"{path.rstrip('/')}/{v}/MANIFEST")[1])]
    kept = {now, *[v for v in done if v != now][::-1][: keep - 1]}
    needed = set(kept)
    for v in kept:
        m = _manifest(spark, path, v)
        needed |= {x for parts in [*m["tables"].values(), m["replaced"]] for x, _ in parts}
    gone = [v for _, v in found if v not in needed]
    for v in gone:
        fs.delete(_fs(spark, f"{path.rstrip('/')}/{v}")[1], True)
    return gone


def enrich_store(spark: SparkSession, path: str, refs: DataFrame) -> tuple[int, int]:
    """As enrich, on the store at `path`; only its references are written."""
    parent = current_version(spark, path)
    old = _manifest(spark, path, parent)
    graph, k, n = enrich(load(spark, path, parent), refs)
    version, number = _new_version(), old["number"] + 1
    _write_refs(graph.refs, f"{path.rstrip('/')}/{version}")
    _write_head(spark, path, version, old | {"number": number, "tables": old["tables"] | {"refs": [[version, number]]}}, graph.meta)
    publish(spark, path, version, parent)
    return k, n


def enrich(graph: CodeGraph, refs: DataFrame) -> tuple[CodeGraph, int, int]:
    """Fill in enclosing symbols from newly derived references (symbol, file, line, enclosing); rows without a match or
    without an enclosing symbol stay as they are. Returns (graph, attributed rows, rows)."""
    if graph.refs is None or graph.refs.isEmpty():
        raise ValueError("the store has no references to enrich")
    s, f = graph.symbols.select("id", "symbol"), graph.files.select(F.col("id").alias("f"), F.col("path").alias("file"))
    new = refs.filter("enclosing is not null").join(s.withColumnRenamed("id", "s"), "symbol").join(s.select(F.col("id").alias("e"), F.col("symbol").alias("enclosing")), "enclosing").join(f, "file", "left").select("s", "f", F.col("line").alias("l"), "e")
    r = graph.refs
    joined = r.join(new, (r["symbol_id"] == new["s"]) & r["file_id"].eqNullSafe(new["f"]) & r["line"].eqNullSafe(new["l"]), "left")
    out = cut(joined.select("symbol_id", "file_id", "line", F.coalesce("e", "enclosing_id").alias("enclosing_id")))
    n, k = out.agg(F.count(F.lit(1)), F.count("enclosing_id")).first()
    meta = dict(graph.meta or {})
    if k:
        meta |= {"has_attributed_refs": "true", "attributed_ref_count": str(k)}
    return CodeGraph(graph.files, graph.symbols, graph.edges, out, meta, graph.names, graph.spans), k, n
