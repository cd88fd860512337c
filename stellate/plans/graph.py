"""A code graph as DataFrames, and its point queries and rankings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.paths import is_test_file, path_ok
from stellate.functions.symbols import is_trivial_callee, matches
from stellate.operators.names import candidates
from stellate.schema import CALLS, INHERITS
from stellate.session import cut

HOTSPOT_KINDS = ("fan_in", "fan_out", "edges")


@dataclass
class CodeGraph:
    """files (id, path), symbols (id, symbol, display_name, file_id, line), edges (kind, src_id, dst_id, file_id, line),
    refs (symbol_id, file_id, line, enclosing_id), meta. `laid` keeps edges as traversals have laid them out, `names` is an index of names,
    `spans` (file_id, bucket, start, end, doc_ord, occ_ord, symbol_id) are bodies by line buckets, if there are any."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    refs: DataFrame | None = None
    meta: dict[str, str] | None = None
    names: DataFrame | None = None
    spans: DataFrame | None = None
    laid: dict = field(default_factory=dict, repr=False, compare=False)

    def sites(self) -> DataFrame:
        """Symbols with the path of their definition."""
        f = self.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
        return self.symbols.join(f, "file_id", "left").select("id", "symbol", "display_name", "file", "line")

    def ids(self, symbol: str) -> list[int]:
        """The ids of a symbol, one at most in a store; as literals they reach the scan of a table sorted by them."""
        return [r["id"] for r in self.symbols.filter(F.col("symbol") == symbol).select("id").collect()]

    def has_symbol(self, symbol: str) -> bool:
        return not self.symbols.filter(F.col("symbol") == symbol).limit(1).isEmpty()

    def get_node(self, symbol: str) -> DataFrame:
        one = CodeGraph(self.files, self.symbols.filter(F.col("symbol") == symbol), self.edges)
        return one.sites().select("symbol", F.coalesce("display_name", F.lit("")).alias("display_name"), "file", "line")

    def find(self, query: str, fuzzy: bool = False) -> DataFrame:
        """Symbols that match every word of the query, in id order."""
        near = self.symbols if self.names is None else candidates(self.names, self.symbols, query, fuzzy)
        one = CodeGraph(self.files, near.filter(matches(F.col("symbol"), F.col("display_name"), query, fuzzy)), self.edges)
        return one.sites().orderBy("id").select("symbol", "display_name", "file", "line")

    def resolve(self, query: str) -> tuple[str | None, DataFrame | None]:
        """(symbol, None), or (None, candidates). Exact, then found, then with # for ::, then fuzzy; never a guess."""
        if self.has_symbol(query):
            return query, None
        tries = [(query, False), *([(query.replace("::", "#"), False)] if "::" in query else []), (query.replace("::", "#"), True)]
        for text, fuzzy in tries:
            found = self.find(text, fuzzy)
            two = found.select("symbol").limit(2).collect()
            if two:
                return (two[0]["symbol"], None) if len(two) == 1 else (None, found)
        return None, None

    def _near(self, symbol: str, kind: str, near: str) -> DataFrame:
        """Edges of a kind with `symbol` at their `near` end, with both symbols, the far end's site and the edge's."""
        far = "src_id" if near == "dst_id" else "dst_id"
        e = self.edges.filter((F.col("kind") == kind) & F.col(near).isin(self.ids(symbol))).withColumn("near", F.lit(symbol))
        there = self.sites().select(F.col("id").alias(far), F.col("symbol").alias("far"), F.col("display_name").alias("far_name"), F.col("file").alias("far_file"), F.col("line").alias("far_line"))
        f = self.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
        return e.join(there, far).join(f, "file_id", "left").select("near", "far", "far_name", "far_file", "far_line", "file", "line")

    def callers(self, symbol: str, exclude_tests: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
        """One row for each call site: src, dst, file, line. Tests and paths are those of the caller's definition."""
        e = filtered(self._near(symbol, CALLS, "dst_id"), exclude_tests, include_paths, exclude_paths)
        return e.select(F.col("far").alias("src"), F.col("near").alias("dst"), "file", "line").orderBy("file", "line", "src")

    def callees(self, symbol: str, exclude_tests: bool = False, include_paths=None, exclude_paths=None, hide_trivial: bool = False) -> DataFrame:
        e = filtered(self._near(symbol, CALLS, "src_id"), exclude_tests, include_paths, exclude_paths)
        if hide_trivial:
            e = e.filter(~is_trivial_callee(F.col("far")))
        return e.select(F.col("near").alias("src"), F.col("far").alias("dst"), "file", "line").orderBy("file", "line", "dst")

    def bases(self, symbol: str) -> DataFrame:
        """The types that `symbol` derives from, a row for each edge, with their definition sites."""
        return self._near(symbol, INHERITS, "src_id").select(F.col("far").alias("symbol"), F.col("far_name").alias("display_name"), F.col("far_file").alias("file"), F.col("far_line").alias("line")).orderBy("file", "line", "symbol")

    def subtypes(self, symbol: str) -> DataFrame:
        return self._near(symbol, INHERITS, "dst_id").select(F.col("far").alias("symbol"), F.col("far_name").alias("display_name"), F.col("far_file").alias("file"), F.col("far_line").alias("line")).orderBy("file", "line", "symbol")

    def references(self, symbol: str, exclude_tests: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
        """Use sites: symbol, file, line, enclosing. Tests and paths are those of the use."""
        if self.refs is None:
            return self.symbols.limit(0).select("symbol", F.lit("").alias("file"), "line", F.lit("").alias("enclosing"))
        f = self.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
        names = self.symbols.select(F.col("id").alias("enclosing_id"), F.col("symbol").alias("enclosing"))
        here = self.refs.filter(F.col("symbol_id").isin(self.ids(symbol)))
        r = here.join(f, "file_id", "left").join(names, "enclosing_id", "left").select(F.lit(symbol).alias("symbol"), "file", "line", "enclosing")
        if exclude_tests:
            r = r.filter(~is_test_file(F.col("file")))
        if include_paths or exclude_paths:
            r = r.filter(path_ok(F.col("file"), include_paths, exclude_paths))
        return r.orderBy("file", "line")

    def degrees(self, kind: str = "fan_in", exclude_tests: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
        """(id, n): call edges at each symbol. A filter holds for the definition files of both ends."""
        if kind not in HOTSPOT_KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        e = self.edges.filter(F.col("kind") == CALLS).select("src_id", "dst_id")
        if exclude_tests or include_paths or exclude_paths:
            ok = path_ok(F.col("file"), include_paths, exclude_paths)
            good = self.sites().filter(ok & ~is_test_file(F.col("file")) if exclude_tests else ok).select("id")
            e = e.join(good.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(good.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
        ends = {"fan_in": ["dst_id"], "fan_out": ["src_id"], "edges": ["src_id", "dst_id"]}[kind]
        parts = [e.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")) for c in ends]
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1]).groupBy("id").agg(F.sum("n").alias("n"))

    def hotspots(self, limit: int = 20, kind: str = "fan_in", exclude_tests: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
        """The `limit` symbols with most calls, equal ones by symbol, and total, the number of symbols with any."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        d = cut(self.degrees(kind, exclude_tests, include_paths, exclude_paths))
        total = F.lit(d.count()).cast("long").alias("total")
        if not limit:
            return self.symbols.limit(0).select("symbol", F.lit(0).cast("long").alias("n"), total)
        # only symbols that reach the count of the last one shown are joined to their names
        least = d.orderBy(F.desc("n")).limit(limit).agg(F.min("n")).first()[0] or 0
        named = d.filter(F.col("n") >= least).join(self.symbols.select("id", "symbol"), "id")
        return named.select("symbol", "n", total).orderBy(F.desc("n"), "symbol").limit(limit)


def filtered(edges: DataFrame, exclude_tests: bool = False, include_paths=None, exclude_paths=None) -> DataFrame:
    """Edges by the definition file of their far end (far_file); without a file an edge stays unless include is given."""
    if exclude_tests:
        edges = edges.filter(~is_test_file(F.col("far_file")))
    if include_paths or exclude_paths:
        edges = edges.filter(path_ok(F.col("far_file"), include_paths, exclude_paths))
    return edges
