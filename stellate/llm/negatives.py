"""Hard negatives by product quantisation, with bounds that make the search exact.

Vectors are integers here. A vector is cut into parts of PART components, each of which is coded by one of at most 256
centroids, whole numbers too, fitted on a bounded sample; the norm of what each part leaves over is stored with the codes.
For an anchor q a table of products with all centroids gives, added up over a row's codes, an approximate score; the true
one differs by at most the sum over the parts of |q part| * |rest part|. What can't reach the sought places by that bound is
left out, the others are scored exactly in integers: nothing is lost, however bad the centroids are.

Two passes over the coded rows: first each anchor's positives (the best rows of its label), then for each positive the best
rows of other labels in its window of scores. Anchors go by in groups of about ANCHORS, which a job holds in its tasks; a
task streams its rows, keeps the best of each list, and lets the bound rise with them. What the tasks found is merged by
anchor. Rows are spread over as many tasks as the cluster has cores, so that what has to be merged doesn't grow with the
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import cut, fresh_path, remove_path, tidy

PART, CENTROIDS, SAMPLE = 2, 256, 8192
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
ANCHOR_EVERY = 100
ANCHORS, ROWS, TILE = 1024, 4096, 256
#: Components up to this size have products and sums that fit into a long for a million of them.
NARROW = 1 << 20
LONG = (1 << 63) - 1

_ENCODED = "rid long, vec_id long, label int, v binary, codes binary, rest binary"


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """Labels moved on by one where `every` divides the id."""
    hit = F.coalesce(F.pmod(F.col(id_col), F.lit(every)) == 0, F.lit(False))
    return vectors.withColumn(label_col, F.when(hit, F.pmod(F.col(label_col) + 1, F.lit(labels))).otherwise(F.col(label_col)).cast("int"))


def sound(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x): the rows that take part, components as doubles."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), x.alias("x"), F.coalesce(fine, F.lit(False)).alias("fine"))
    return rows.filter("fine and label is not null").drop("fine")


def centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 6, seed: int = 42) -> np.ndarray:
    """(parts, k, PART) whole numbers: k-means of each part of the sample's rows."""
    rng = np.random.default_rng(seed)
    parts = sample.reshape(len(sample), -1, PART).astype(np.float64)
    out = np.zeros((parts.shape[1], k, PART), np.int64)
    for m in range(parts.shape[1]):
        x = parts[:, m]
        c = x[rng.permutation(len(x))[:k]] if len(x) >= k else np.vstack([x, np.zeros((k - len(x), PART))])
        for _ in range(rounds):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=k)
            for j in range(PART):
                c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], k) / np.maximum(n, 1), c[:, j])
        out[m] = np.rint(c)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (np.square(c).sum(1)[None] - 2 * (x @ c.T)).argmin(1)


def encode(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and the norms of what is left over, rounded up."""
    parts = v.reshape(len(v), -1, PART)
    codes = np.empty(parts.shape[:2], np.uint8)
    rest = np.empty(parts.shape[:2], np.float32)
    for m, c in enumerate(book):
        codes[:, m] = _nearest(parts[:, m].astype(np.float64), c.astype(np.float64))
        left = (parts[:, m] - c[codes[:, m]]).astype(np.float64)
        rest[:, m] = np.nextafter((np.sqrt(np.square(left).sum(1)) * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))
    return codes, rest


class Tables:
    """Products of anchors with all centroids."""

    def __init__(self, anchors: np.ndarray, book: np.ndarray):
        parts = anchors.reshape(len(anchors), -1, PART)
        table = np.einsum("amj,mkj->mka", parts, book)
        self.table = table.astype(np.int32) if int(np.abs(table).max(initial=0)) * len(book) < 2**31 else table
        self.norms = np.sqrt(np.square(parts.astype(np.float64)).sum(2)).T * (1 + 1e-9)  # parts, anchors

    def bounds(self, codes: np.ndarray, rest: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores (rows, anchors), widened by more than float arithmetic errs by."""
        table = np.ascontiguousarray(self.table[:, :, some])
        about = np.zeros((len(codes), table.shape[2]), table.dtype)
        for m in range(codes.shape[1]):
            about += table[m][codes[:, m]]
        slack = rest.astype(np.float64) @ self.norms[:, some]
        slack += slack * 1e-9 + np.abs(about) * 2.0**-48 + 1
        return about - slack, about + slack


def exact(q: np.ndarray, v: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of anchors a with rows r."""
    out = [(q[a[i : i + 65536]] * v[r[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


LEAST = -(1 << 62)


class Best:
    """For each of n lists the best k rows seen: higher scores first, then smaller ids, then rows. `bar` is what a list's
    k-th row scores, and at first what `floor` gives."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.bar = k, floor.copy()
        self.rows = [np.zeros(0, np.int64), np.zeros(0, floor.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # list, score, id, rid

    def add(self, found: list[tuple[np.ndarray, ...]]) -> None:
        """found: (lists, scores, ids, rids)"""
        if not sum(len(f[0]) for f in found):
            return
        every = [np.concatenate(p) for p in zip(self.rows, *found, strict=True)]
        if every[1].dtype == object:
            order = np.array(sorted(range(len(every[0])), key=lambda i: (every[0][i], -every[1][i], every[2][i], every[3][i])))
        else:
            order = np.lexsort((every[3], every[2], -every[1], every[0]))
        every = [e[order] for e in every]
        place = np.arange(len(every[0])) - np.searchsorted(every[0], every[0])
        last = place == self.k - 1
        self.bar[every[0][last]] = np.maximum(self.bar[every[0][last]], every[1][last])
        self.rows = [e[place < self.k] for e in every]


def _columns(b: pa.RecordBatch, parts: int) -> tuple:
    """rid, id, label, vectors, codes and rests of a batch; without parts the last two are of that length only."""
    rid, ids, label = (b.column(i).to_numpy() for i in range(3))
    flat = b"".join(b.column(3).to_pylist())
    if not parts:
        return rid, ids, label, np.array([int(x) for x in np.frombuffer(flat, np.float64)], object).reshape(len(rid), -1), rid, rid
    codes, rest = (np.frombuffer(b"".join(b.column(i).to_pylist()), t).reshape(-1, parts) for i, t in ((4, np.uint8), (5, np.float32)))
    return rid, ids, label, np.frombuffer(flat, np.int32).reshape(len(rid), -1).astype(np.int64), codes, rest


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


class Search:
    """Both passes over the coded rows, for one group of anchors (rid, vec_id, label, q) in order of labels; sent to the
    tasks."""

    def __init__(self, anchors: list[tuple], book: np.ndarray | None):
        self.rid = np.array([a[0] for a in anchors], np.int64)
        self.label = np.array([a[2] for a in anchors], np.int64)
        self.kind = object if book is None else np.int64
        self.q = np.array([a[3] for a in anchors], self.kind).reshape(len(anchors), -1)
        self.book, self.parts = book, 0 if book is None else len(book)
        self.tables = None

    def _pairs(self, codes, rest, mine: slice, bar: np.ndarray, cap: np.ndarray | None, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchors of the slice) whose score can be from bar to cap, and, with k, among the best k of these rows,
        their own row apart; all pairs without a book."""
        if self.book is None:
            r, a = np.indices((len(codes), mine.stop - mine.start))
            return r.ravel(), a.ravel()
        if self.tables is None:
            self.tables = Tables(self.q, self.book)
        lo, hi = self.tables.bounds(codes, rest, mine)
        bar = bar.astype(np.float64)
        if own is not None and len(lo) > k:
            lo[own] = -np.inf
            bar = np.maximum(bar, -np.partition(-lo, k - 1, axis=0)[k - 1])
        fits = hi >= bar
        if cap is not None:
            fits &= lo <= cap.astype(np.float64)
        return np.nonzero(fits)

    def positives(self, batches: Iterator[pa.RecordBatch], k: int) -> Best:
        """The best k other rows of each anchor's label among these rows."""
        best = Best(np.full(len(self.q), LEAST if self.kind is np.int64 else -(1 << 400), self.kind), k)
        for b in batches:
            rid, ids, label, v, codes, rest = _columns(b, self.parts)
            for lab in np.intersect1d(label, self.label).tolist():
                here = np.flatnonzero(label == lab)
                for mine in _slices(self.label, lab):
                    own = rid[here][:, None] == self.rid[mine]
                    r, a = self._pairs(codes[here], rest[here], mine, best.bar[mine], None, own, k)
                    other = ~own[r, a]
                    r, a = here[r[other]], a[other] + mine.start
                    best.add([(a, exact(self.q, v, a, r), ids[r], rid[r])])
        return best

    def negatives(self, batches: Iterator[pa.RecordBatch], windows: list[list[tuple[int, int]]], k: int) -> Best:
        """windows: of each anchor (least, greatest score), equally many. The best k rows of other labels in each; list
        number: anchor * windows + window. An empty window has a least score beyond the greatest."""
        w = np.array(windows, self.kind).reshape(len(self.q), -1, 2)
        most, cap = w.shape[1], w[:, :, 1]
        best = Best(w[:, :, 0].ravel(), k)
        for b in batches:
            rid, ids, label, v, codes, rest = _columns(b, self.parts)
            found = []
            for t in range(0, len(self.q), TILE):
                mine = slice(t, min(t + TILE, len(self.q)))
                bars = best.bar.reshape(-1, most)
                r, a = self._pairs(codes, rest, mine, bars[mine].min(1), cap[mine].max(1), None, k)
                apart = label[r] != self.label[mine][a]
                r, a = r[apart], a[apart] + t
                score = exact(self.q, v, a, r)
                for j in range(most):
                    hit = np.flatnonzero((score >= bars[a, j]) & (score <= cap[a, j]))
                    found.append((a[hit] * most + j, score[hit], ids[r[hit]], rid[r[hit]]))
            best.add(found)
        return best


def _slices(labels: np.ndarray, label: int) -> Iterator[slice]:
    """The places of a label in the sorted labels, TILE at a time."""
    a, b = np.searchsorted(labels, [label, label + 1]).tolist()
    for t in range(a, b, TILE):
        yield slice(t, min(t + TILE, b))


def _long(x) -> int:
    return max(-LONG - 1, min(LONG, int(x)))


def encoded(rows: DataFrame, path: str) -> tuple[DataFrame, np.ndarray | None]:
    """The table of _ENCODED at `path`, and the centroids; no codes and no centroids if a component is beyond NARROW.
    Vectors shorter than the longest count as filled up with zeros."""
    largest, dims = rows.agg(F.max(F.array_max(F.transform("x", F.abs))), F.max(F.size("x"))).first()
    wide, dims = 256 * (largest or 0) >= NARROW, max(PART, -(-(dims or 0) // PART) * PART)
    book = None
    if not wide:
        h = F.xxhash64("vec_id", "label", "x")
        sample = rows.select(h.alias("h"), "x").orderBy("h").limit(SAMPLE).select("x").toArrow()  # the least hashes: a bounded sample
        if not sample.num_rows:
            return rows.sparkSession.createDataFrame([], _ENCODED), None
        book = centroids(_matrix(sample["x"].combine_chunks(), dims))

    def run(batches):
        for p in _tiles(batches):
            v = _matrix(p.column(3), dims)
            cols = [p.column(0), p.column(1), p.column(2)]
            if wide:
                cols += [pa.array([r.tobytes() for r in v], pa.binary()), pa.nulls(len(v), pa.binary()), pa.nulls(len(v), pa.binary())]
            else:
                codes, rest = encode(v.astype(np.int64), book)
                cols += [pa.array([r.tobytes() for r in x], pa.binary()) for x in (v.astype(np.int32), codes, rest)]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "vec_id", "label", "v", "codes", "rest"])

    with tidy(rows.sparkSession):
        rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "x").mapInArrow(run, _ENCODED).write.parquet(path)
    return rows.sparkSession.read.schema(_ENCODED).parquet(path), book


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of floor(256 * x), as doubles, filled up with zeros."""
    out = np.zeros((len(lists), dims))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.floor(256 * out)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row of which
    `anchor_every` divides the id) and each of its first `positives` other rows of the label, the first `negatives` rows of
    other labels whose score is from `low` to `high` hundredths of the positive's.

    Rows with a null label, vector or component, or one that isn't finite, take no part; a null id is no anchor and comes
    last among equal scores. Scores are exact; ties go by smaller ids, then by the place in the table. Repeated rows are rows
    of their own: a copy of an anchor is an anchor itself and may be the other's positive. Vectors of unequal length
    count as filled up with zeros; an empty one has only scores of 0. A positive of negative score has no negatives. Where a
    component is beyond 2 ** 20, all scores are computed without bounds in unlimited integers, which is slow, and shown
    no larger than a long. Columns that aren't named are not read. Without anchors there are no rows.
    """
    spark = vectors.sparkSession
    at = fresh_path(spark, "negatives")
    rows = sound(vectors, id_col, vector_col, label_col)
    table, book = encoded(rows, f"{at}/rows")
    is_anchor = F.pmod("vec_id", F.lit(anchor_every)) == 0
    n = table.filter(is_anchor).count()
    groups = max(1, -(-n // group))
    cores = spark.sparkContext.defaultParallelism
    for g in range(groups):
        own = table.filter(is_anchor & (F.pmod(F.xxhash64("rid"), F.lit(groups)) == g)).select("rid", "vec_id", "label", "v")  # about `group` rows
        _group(table.coalesce(cores), own, book, positives, negatives, low, high, f"{at}/found/g={g}")
    out = spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(*[f"{at}/found/g={g}" for g in range(groups)])
    remove_path(spark, f"{at}/rows")
    return out


#: key orders scores that a long can't hold: the score moved up to a positive number of BIG's digits.
_FOUND = "anchor int, list int, score long, key string, id long, rid long"
BIG = 2 * 10**120


def _rows_of(best: Best, most: int) -> Iterator[pa.RecordBatch]:
    lists, score, ids, rid = best.rows
    if len(lists):
        wide = score.dtype == object
        cols = [pa.array(lists // most, pa.int32()), pa.array(lists % most, pa.int32()), pa.array([_long(s) for s in score], pa.int64()), pa.array([str(BIG + s) for s in score], pa.string()) if wide else pa.nulls(len(lists), pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([None if i == LONG else i for i in ids.tolist()], pa.int64()), pa.array(rid, pa.int64())], ["anchor", "list", "score", "key", "id", "rid"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "list").orderBy(F.desc("key"), F.desc("score"), F.asc_nulls_last("id"), "rid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _group(table: DataFrame, own: DataFrame, book, positives: int, negatives: int, low: int, high: int, path: str) -> None:
    """Writes the rows of one group of anchors. What comes to the driver is the group itself and its positives."""
    spark = table.sparkSession
    wide = book is None
    anchors = [(r["rid"], r["vec_id"], r["label"], [int(x) for x in np.frombuffer(bytes(r["v"]), np.float64 if wide else np.int32)]) for r in own.sort("label", "rid").collect()]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        spark.createDataFrame([], schema).write.parquet(path)
        return
    src = table.select("rid", F.coalesce("vec_id", F.lit(LONG)).alias("vec_id"), "label", "v", "codes", "rest")
    sent = spark.sparkContext.broadcast(Search(anchors, book))

    def first(batches):
        yield from _rows_of(sent.value.positives(_tiles(batches), positives), 1)

    best = _merged(src.mapInArrow(first, _FOUND), positives).sort("anchor", "rank").collect()
    windows: list[list[tuple[int, int]]] = [[] for _ in anchors]
    chosen: list[list[tuple]] = [[] for _ in anchors]
    for r in best:
        s = int(r["key"]) - BIG if r["key"] else r["score"]
        windows[r["anchor"]].append((-(-low * s // 100), high * s // 100))
        chosen[r["anchor"]].append((r["id"], s))
    most = max(map(len, windows)) or 1
    for w in windows:
        w += [(-LEAST, LEAST)] * (most - len(w))
    seen = spark.sparkContext.broadcast(windows)

    def second(batches):
        yield from _rows_of(sent.value.negatives(_tiles(batches), seen.value, negatives), most)

    found = _merged(src.mapInArrow(second, _FOUND), negatives)
    pairs = [(i, j, a[1], p, _long(s)) for i, a in enumerate(anchors) for j, (p, s) in enumerate(chosen[i])]
    names = spark.createDataFrame(pairs, "anchor int, list int, anchor_id long, positive_id long, positive_score long")  # positives of one group
    with tidy(spark):
        found.join(F.broadcast(names), ["anchor", "list"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).coalesce(1).write.parquet(path)
    sent.unpersist()
    seen.unpersist()
