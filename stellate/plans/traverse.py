"""Traversals: impact, shortest paths and subgraphs by frontiers.

A traversal that needs few pairs (counted first, at most `local_pairs`) is done on the driver over the adjacency, which
one job brings in as Arrow. Beyond that bound up to SHALLOW levels are a scan of the edges each; for more, edges are laid out once by the end that a traversal starts from, in the shared
folder, and each round joins the frontier with them and drops what was seen: frontiers and what was seen lie by their ids
in as many partitions, so that a round moves the ends that it found and no edges. A symbol with over HOT edges is dealt over
SALTS keys. Both ways give the same rows; `local_pairs` 0 always takes the second.

A shortest path is searched from both ends, the smaller frontier first, up to where they meet; then only symbols on
shortest paths are followed back.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.plans.graph import CodeGraph
from stellate.schema import CALLS
from stellate.session import cut, cut_as_laid

LOCAL_PAIRS, COMPACT = 200_000, 8
SHALLOW = 2  # levels up to which edges are scanned for each and not laid out
HOT, SALTS = 100_000, 16
SMALL = 1_000_000  # ids that are broadcast at most


def _pairs(graph: CodeGraph, kind: str | None) -> DataFrame:
    e = graph.edges if kind is None else graph.edges.filter(F.col("kind") == kind)
    return e.select("src_id", "dst_id").distinct()


def _small(pairs: DataFrame, bound: int) -> dict[str, list[int]] | None:
    """The pairs on the driver, if there are no more than `bound`."""
    got: pa.Table = pairs.limit(bound + 1).toArrow()
    return got.to_pydict() if got.num_rows <= bound else None


def _adjacency(src: list[int], dst: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
    return out


def _ids(graph: CodeGraph, symbol: str) -> list[int]:
    return [r["id"] for r in graph.symbols.filter(F.col("symbol") == symbol).select("id").limit(1).collect()]


class Laid:
    """Edges of a kind as (a, b), partitioned by a (and a salt of the hot ones), and the hot ids."""

    def __init__(self, graph: CodeGraph, kind: str | None, direction: str):
        spark = graph.edges.sparkSession
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        e = graph.edges if kind is None else graph.edges.filter(F.col("kind") == kind)
        ways = [e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))] * (direction in ("out", "both")) + [e.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))] * (direction in ("in", "both"))
        pairs = reduce(DataFrame.union, ways)
        hot = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("a", F.lit(SALTS).alias("salts")))
        self.hot = None if hot.isEmpty() else hot  # at most a HOT-th of the edges
        self.keys = ["a"] if self.hot is None else ["a", "salt"]
        if self.hot is not None:
            salted = pairs.join(F.broadcast(hot) if hot.count() <= SMALL else hot, "a", "left")
            pairs = salted.select("a", "b", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
        self.pairs = cut_as_laid(pairs.repartition(self.n, *self.keys).distinct().sortWithinPartitions(*self.keys))

    def front(self, ids: DataFrame) -> DataFrame:
        f = ids.select(F.col("id").alias("a"))
        if self.hot is None:
            return f
        salts = f.join(F.broadcast(self.hot) if self.hot.count() <= SMALL else self.hot, "a", "left")
        return salts.select("a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))

    def ends(self, ids: DataFrame) -> DataFrame:
        """(id): the far ends of edges of `ids`, once each."""
        return self.pairs.join(self.front(ids), self.keys).select(F.col("b").alias("id")).distinct()


def laid(graph: CodeGraph, kind: str | None, direction: str) -> Laid:
    key = kind, direction
    if key not in graph.laid:
        graph.laid[key] = Laid(graph, kind, direction)
    return graph.laid[key]


class Ball:
    """What can be reached from a start: levels[k] (id) at k edges, all laid out alike."""

    def __init__(self, start: int, edges: Laid):
        spark = edges.pairs.sparkSession
        self.edges = edges
        self.levels = [cut_as_laid(spark.createDataFrame([(start,)], "id long").repartition(edges.n, "id"))]
        self.sizes, self.older = [1], []  # older: levels brought together

    def grow(self) -> int:
        """Adds a level; its size."""
        new = self.edges.ends(self.levels[-1])
        recent = self.levels[len(self.older) * COMPACT :]
        for seen in [*self.older, *recent]:
            new = new.join(seen, "id", "left_anti")
        self.levels.append(cut_as_laid(new))
        self.sizes.append(self.levels[-1].count())
        if len(recent) == COMPACT:
            self.older.append(cut_as_laid(reduce(DataFrame.union, recent).repartition(self.edges.n, "id")))
        return self.sizes[-1]


def reach(graph: CodeGraph, start: int, kind: str | None, direction: str, max_depth: int | None, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """(id, depth) of all that can be reached from `start`, itself at depth 0; direction in, out or both."""
    spark = graph.edges.sparkSession
    if direction not in ("in", "out", "both"):
        return spark.createDataFrame([(start, 0)], "id long, depth long")
    small = _small(_pairs(graph, kind), local_pairs) if local_pairs else None
    if small is not None:
        nexts = [_adjacency(small["src_id"], small["dst_id"])] * (direction != "in") + [_adjacency(small["dst_id"], small["src_id"])] * (direction != "out")
        depth = _levels(nexts, start, max_depth)
        return spark.createDataFrame(pa.table({"id": pa.array(depth.keys(), pa.int64()), "depth": pa.array(depth.values(), pa.int64())}))
    if max_depth is not None and max_depth <= SHALLOW and (kind, direction) not in graph.laid:
        return _scanned(graph, start, kind, direction, max_depth)
    ball = Ball(start, laid(graph, kind, direction))
    while (max_depth is None or len(ball.levels) <= max_depth) and ball.grow():
        pass
    return reduce(DataFrame.union, [x.select("id", F.lit(d).cast("long").alias("depth")) for d, x in enumerate(ball.levels)])


def _scanned(graph: CodeGraph, start: int, kind: str | None, direction: str, max_depth: int) -> DataFrame:
    """As reach, by a scan of the edges for each of a few levels: laying them out would move and sort all of them for that."""
    e = graph.edges if kind is None else graph.edges.filter(F.col("kind") == kind)
    levels = [cut(graph.edges.sparkSession.createDataFrame([(start,)], "id long"))]
    for _ in range(max_depth):
        n = levels[-1].count()
        if not n:
            break
        near = F.broadcast(levels[-1]) if n <= SMALL else levels[-1]
        ways = [("src_id", "dst_id")] * (direction != "in") + [("dst_id", "src_id")] * (direction != "out")
        new = reduce(DataFrame.union, [e.join(near.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id")) for a, b in ways]).distinct()
        for seen in levels:
            new = new.join(seen, "id", "left_anti")
        levels.append(cut(new))
    return reduce(DataFrame.union, [x.select("id", F.lit(d).cast("long").alias("depth")) for d, x in enumerate(levels)])


def _levels(nexts: list[dict[int, list[int]]], start: int, max_depth: int | None, stop: int | None = None) -> dict[int, int]:
    """Depths on the driver; with `stop` up to the level that holds it."""
    depth, front = {start: 0}, [start]
    while front and stop not in depth and (max_depth is None or depth[front[0]] < max_depth):
        d, new = depth[front[0]] + 1, []
        for v in front:
            for adjacent in nexts:
                for w in adjacent.get(v, ()):
                    if w not in depth:
                        depth[w] = d
                        new.append(w)
        front = new
    return depth


def impact(graph: CodeGraph, symbol: str, max_depth: int | None = None, kind: str = CALLS, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """(symbol, depth) of everything that reaches `symbol` along edges of a kind, without itself, even on a cycle."""
    start = _ids(graph, symbol)
    if not start:
        return graph.symbols.limit(0).select("symbol", F.lit(0).cast("long").alias("depth"))
    found = reach(graph, start[0], kind, "in", max_depth, local_pairs).filter("depth > 0")
    return found.join(graph.symbols.select("id", "symbol"), "id").select("symbol", "depth").orderBy("symbol")


def _between(graph: CodeGraph, one: int, two: int) -> list[DataFrame] | None:
    """[(id) at k edges from `one`], of which those beyond the meeting level are on shortest paths to `two`; k is less than
    the length of these. None without a path."""
    ahead, back = Ball(one, laid(graph, CALLS, "out")), Ball(two, laid(graph, CALLS, "in"))
    while True:
        ball = ahead if ahead.sizes[-1] <= back.sizes[-1] else back
        if not ball.grow():
            return None
        met = cut_as_laid(ahead.levels[-1].join(back.levels[-1], "id", "left_semi"))
        if not met.isEmpty():
            break
    levels = ahead.levels[:-1]
    on_path = met
    for k in range(len(back.levels) - 1, 0, -1):  # from the meeting level towards `two`, by what leads on
        levels.append(on_path)
        on_path = cut_as_laid(back.levels[k - 1].join(ahead.edges.ends(on_path), "id", "left_semi"))
    return levels


def shortest_call_path(graph: CodeGraph, src: str, dst: str, local_pairs: int = LOCAL_PAIRS) -> DataFrame | None:
    """The edges of a shortest call path (hop, src, dst, file, line): none if both are one, None if there is no path.

    Of all shortest paths the one is taken that, from the end backwards, has the least symbol, then file and line."""
    one, two = _ids(graph, src), _ids(graph, dst)
    spark = graph.edges.sparkSession
    schema = "hop long, src string, dst string, file string, line int"
    if not one or not two:
        return None
    if one == two:
        return spark.createDataFrame([], schema)
    small = _small(_pairs(graph, CALLS), local_pairs) if local_pairs else None
    if small is None:
        levels = _between(graph, one[0], two[0])
        if levels is None:
            return None
    else:
        depth = _levels([_adjacency(small["src_id"], small["dst_id"])], one[0], None, two[0])
        if two[0] not in depth:
            return None
        by: list[list[int]] = [[] for _ in range(depth[two[0]])]
        for v, d in depth.items():
            if d < len(by):
                by[d].append(v)
        levels = [spark.createDataFrame(pa.table({"id": pa.array(x, pa.int64())})) for x in by]
    names = graph.symbols.select(F.col("id").alias("src_id"), "symbol")
    f = graph.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    rows, at, at_name = [], two[0], dst
    for hop in range(len(levels), 0, -1):  # a lookup for each hop of the path: edges into one symbol
        into = graph.edges.filter((F.col("kind") == CALLS) & (F.col("dst_id") == at)).join(levels[hop - 1].withColumnRenamed("id", "src_id"), "src_id", "left_semi")
        best = into.join(names, "src_id").join(f, "file_id", "left").agg(F.min(F.struct("symbol", "file", "line", "src_id")).alias("r")).first()["r"]
        rows.append((hop, best["symbol"], at_name, best["file"], best["line"]))
        at, at_name = best["src_id"], best["symbol"]
    return spark.createDataFrame(rows[::-1], schema).orderBy("hop")


def subgraph(graph: CodeGraph, symbol: str, depth: int = 2, direction: str = "both", local_pairs: int = LOCAL_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what lies within `depth` edges of any kind, and all edges between those nodes."""
    start = _ids(graph, symbol)
    f = graph.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    if start:
        near = cut(reach(graph, start[0], None, direction, depth, local_pairs).select("id"))
    else:
        near = graph.symbols.limit(0).select("id")
    nodes = graph.sites().join(near, "id", "left_semi").orderBy("symbol").select("symbol", "display_name", "file", "line")
    few = F.broadcast(near) if near.count() <= SMALL else near
    # names and files of what was found alone, so that no join behind the search moves the whole tables
    inside = cut(graph.edges.join(few.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(few.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi"))
    names = cut(graph.symbols.select("id", "symbol").join(few, "id", "left_semi"))
    used = cut(inside.select("file_id").distinct())
    f = f.join(F.broadcast(used) if used.count() <= SMALL else used, "file_id", "left_semi")
    edges = inside.join(names.select(F.col("id").alias("src_id"), F.col("symbol").alias("src")), "src_id").join(names.select(F.col("id").alias("dst_id"), F.col("symbol").alias("dst")), "dst_id").join(f, "file_id", "left")
    return nodes, edges.select("kind", "src", "dst", "file", "line").orderBy("kind", "src", "dst", "file", "line")
