"""SimHash near-duplicates: fingerprints of word shingles, Golay buckets, exact links within a radius, components.

Two modes. NARROW: 64 bits (XXH64), links of at most 3 bits, all of which are found. WIDE: 128 bits (XXH3), links of at
most 30 bits: texts that share 0.8 of their shingles differ in 19.4 by expectation, with a deviation of about 4. Buckets are made of
each half and of two mixtures of the halves; they hold all links of which one of these differs in 6 bits or fewer and many others:
of pairs that differ in 19 bits 99.9 %, in 22 bits 98.5 %, in 25 bits 95 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm import golay
from stellate.llm.common import bounded_batches, by_bytes, cut, remove_path, row_key, settled, written
from stellate.llm.components import components

SHINGLE, SEED = 3, 42
MAX_BUCKET = 32_768
MAX_GROUP = 512
SIMILARITY = 0.8
SMALL_RUN = 16
SHINGLE_BLOCK = 1 << 16


@dataclass(frozen=True)
class Mode:
    words: int  # of 64 bits
    radius: int


NARROW, WIDE = Mode(1, 3), Mode(2, 30)


def fingerprint(text: bytes, shingle: int = SHINGLE, mode: Mode = NARROW) -> np.ndarray:
    """SimHash of UTF-8 bytes, as 64-bit words: ASCII lower case, words by ASCII white space, shingles of words with
    repeats.

    A text of fewer words has one shingle of all of them; one without words has the fingerprint 0. A bit is set if more
    than half of the shingles' hashes have it.
    """
    from xxhash import xxh3_128_digest, xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(mode.words, np.uint64)
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    ones = np.zeros(64 * mode.words, np.int64)
    for k in range(0, n, SHINGLE_BLOCK):
        spans = zip(starts[k : min(k + SHINGLE_BLOCK, n)].tolist(), ends[min(len(words), shingle) - 1 + k :].tolist(), strict=False)
        if mode.words == 1:
            raw = np.array([xxh64_intdigest(line[i:j], SEED) for i, j in spans], "<u8").view(np.uint8)
        else:
            raw = np.frombuffer(b"".join([xxh3_128_digest(line[i:j], SEED) for i, j in spans]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8 * mode.words), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, mode: Mode = NARROW) -> DataFrame:
    """(id, key, fp, fp2) of each row; a null text has no words; fp2 is 0 in narrow mode. key tells rows with one id but
    different texts apart."""
    src = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for b in by_bytes(batches, "text"):
            fps = np.zeros((b.num_rows, 2), np.uint64)
            fps[:, : mode.words] = [fingerprint(t, shingle, mode) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(fps[:, i].copy().view(np.int64)) for i in (0, 1))], ["id", "key", "fp", "fp2"])

    return bounded_batches(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, key long, fp long, fp2 long")


def _near(a: np.ndarray, b: np.ndarray, mode: Mode) -> np.ndarray:
    bits = np.bitwise_count(a[..., 0] ^ b[..., 0])
    return (bits if mode.words == 1 else bits + np.bitwise_count(a[..., 1] ^ b[..., 1])) <= mode.radius


def _stars(fps: np.ndarray, mode: Mode) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, first one of its component) among distinct fingerprints, by search from one to its neighbours."""
    us, vs, rest = [], [], fps
    while len(rest):
        root, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            near = _near(rest, todo.pop(), mode)
            if near.any():
                found = rest[near]
                us.append(found)
                vs.append(np.broadcast_to(root, found.shape))
                rest = rest[~near]
                todo.extend(found)
    none = np.empty((0, 2), np.uint64)
    return np.concatenate(us or [none]), np.concatenate(vs or [none])


def _small_stars(rows: np.ndarray, mode: Mode) -> tuple[np.ndarray, np.ndarray]:
    """The same for many buckets of one size, a row each."""
    n, m = rows.shape[:2]
    near = _near(rows[:, :, None], rows[:, None, :], mode)
    label = np.broadcast_to(np.arange(m), (n, m))
    while True:
        better = np.where(near, label[:, None, :], m).min(axis=2)
        if (better == label).all():
            break
        label = better
    r, c = np.nonzero(label != np.arange(m))
    return rows[r, c], rows[r, label[r, c]]


def _node(fps: np.ndarray) -> pa.Array:
    """Both words, big-endian, as 16 bytes."""
    raw = pa.py_buffer(fps.astype(">u8").tobytes())
    return pa.Array.from_buffers(pa.binary(16), len(fps), [None, raw]).cast(pa.binary())


def node():
    """The same as a column of fp and fp2."""
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return F.concat(word("fp"), word("fp2"))


_LINKS = "u binary, v binary, key long, fp long, fp2 long"


def bucket_links(batches: Iterator[pa.RecordBatch], mode: Mode = NARROW, limit: int | None = MAX_BUCKET) -> Iterator[pa.RecordBatch]:
    """(key, fp, fp2) sorted by key -> (u, v, null, null, null): links of nodes as stars within each bucket; a bucket of
    more than `limit` is handed on instead, as (null, null, key, fp, fp2)."""
    none = np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    (held_k, held_f), over = none, None

    def out(u, v):
        return pa.RecordBatch.from_arrays([_node(u), _node(v), *(pa.nulls(len(u), pa.int64()) for _ in range(3))], ["u", "v", "key", "fp", "fp2"])

    def hand_on(key, fps):
        n = len(fps)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(np.full(n, key)), *(pa.array(fps[:, i].copy().view(np.int64)) for i in (0, 1))], ["u", "v", "key", "fp", "fp2"])

    def solve(k, f):
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(k)]]))
        for m in np.unique(sizes):
            if m < 2:
                continue
            at = starts[sizes == m]
            if m <= SMALL_RUN:
                for i in range(0, len(at), 4096):
                    yield out(*_small_stars(f[at[i : i + 4096, None] + np.arange(m)], mode))
            else:
                for i in at:
                    yield out(*_stars(f[i : i + m], mode))

    for b in batches:
        k = b.column(0).to_numpy()
        f = np.stack([b.column(i).to_numpy().view(np.uint64) for i in (1, 2)], axis=1)
        if over is not None:
            same = k == over
            if same.any():
                yield hand_on(over, f[same])
                k, f = k[~same], f[~same]
        if not len(k):
            continue
        over = None
        k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
        last = np.searchsorted(k, k[-1])
        if last:
            yield from solve(k[:last], f[:last])
        held_k, held_f = k[last:], f[last:]
        if limit is not None and len(held_k) > limit:
            over = int(held_k[0])
            yield hand_on(over, held_f)
            held_k, held_f = none
    if len(held_k):
        yield from solve(held_k, held_f)


def _collapsed(found: DataFrame) -> DataFrame:
    """The same components with fewer links: each node keeps its least root, its other roots are linked to that one. A
    node has at most as many roots as it has buckets; in a dense group most nodes share theirs."""
    per = found.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("roots"))
    between = per.select(F.explode("roots").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return per.select("u", F.col("m").alias("v")).union(between)


def links(fps: DataFrame, mode: Mode = NARROW, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(u, v), nodes of distinct fingerprints (fp, fp2), so that their components are those of all links that share a
    bucket. A bucket of more than max_bucket is dealt out in blocks, each pair of which is one smaller bucket."""
    def keyed(batches):
        for b in batches:
            f = [b.column(i).to_numpy() for i in (0, 1)]
            for i in range(0, len(f[0]), 2_000):
                half = [x[i : i + 2_000].view(np.uint64) for x in f]
                for rows, keys in [golay.keys(half[0])] if mode.words == 1 else (golay.wide_keys(x, w) for w, x in enumerate(golay.mixtures(*half))):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x[i + rows]) for x in f)], ["key", "fp", "fp2"])

    def solved(df, limit):
        return df.repartition("key").sortWithinPartitions("key", "fp", "fp2").mapInArrow(lambda batches: bucket_links(batches, mode, limit), _LINKS)

    first = cut(solved(fps.select("fp", "fp2").mapInArrow(keyed, "key long, fp long, fp2 long"), max_bucket))
    found = first.filter("v is not null").select("u", "v")
    over = first.filter("v is null").select("key", "fp", "fp2")
    if over.isEmpty():
        return _collapsed(found)
    blocks = over.join(over.groupBy("key").agg(F.ceil(2 * F.count(F.lit(1)) / max_bucket).cast("int").alias("n")), "key").withColumn("b", F.pmod(F.xxhash64("fp", "fp2"), F.col("n")).cast("int"))
    dealt = blocks.select("key", "fp", "fp2", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "fp", "fp2").distinct()
    return _collapsed(found.union(solved(dealt, None).select("u", "v")))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; words and short texts as in fingerprint."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxh3_64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def _similar(units: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (unit, a similar unit) with the components of all pairs whose Jaccard similarity is at least `similarity`."""
    names, sizes = np.array(units, np.int64), np.array([len(s) for s in sets])
    us, vs, rest = [], [], np.arange(len(units))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            fit = rest[np.minimum(sizes[rest], sizes[x]) + 1e-9 >= similarity * np.maximum(sizes[rest], sizes[x])]
            if not len(fit):
                continue
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in fit])
            found = fit[shared + 1e-9 >= similarity * (sizes[fit] + sizes[x] - shared)]
            us.append(names[found])
            vs.append(np.full(len(found), names[x]))
            rest = np.setdiff1d(rest, found, assume_unique=True)
            todo.extend(found)
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _share(a: np.ndarray, b: np.ndarray) -> float:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / max(1, len(a) + len(b) - n)


def verified(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, max_group: int = MAX_GROUP) -> DataFrame:
    """groups (unit, group), unit the key of a row of `docs` -> (node, component): the components of the pairs within a group
    whose shingle sets have a Jaccard similarity of at least `similarity`.

    A group of up to max_group is compared in one task. Of a larger one each text is compared with the group's least unit,
    in a join that doesn't gather the group; those that are like it are in one component, so that only pairs with one of
    the others are open: these and all texts of the group are dealt out in blocks, a block of either kind for each task.
    """
    groups = groups.select("unit", F.xxhash64("group").alias("group"))  # two groups of one hash would be compared as one
    sizes = cut(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("centre")).filter("n > 1"))
    wanted = groups.join(sizes, "group").select("unit", "group", "n", (F.col("unit") == F.col("centre")).alias("central"))
    texts = docs.select(row_key(id_col, text_col).alias("unit"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).join(wanted, "unit").select("group", "unit", "n", "central", "text")

    def sets(batches):
        for b in by_bytes(batches, "text"):
            found = [shingle_set(t, shingle).view(np.int64) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(pa.int64()))], ["group", "unit", "n", "central", "shingles"])

    def near(batches):
        for b in batches:
            like = [_share(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) + 1e-9 >= similarity for x, y in zip(b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(like)], ["group", "unit", "centre", "like"])

    def solve(batches):
        at, units, held = None, [], []
        for b in batches:
            for g, u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if g != at and units:
                    yield from _similar(units, held, similarity)
                    units, held = [], []
                if g == at and units and units[-1] == u:
                    continue  # another row of the same key
                at = g
                units.append(u)
                held.append(x.values.to_numpy(zero_copy_only=False))
        if units:
            yield from _similar(units, held, similarity)

    hashed, path = written(bounded_batches(texts).mapInArrow(sets, "group long, unit long, n long, central boolean, shingles array<long>"), "shingles")
    cells, links_ = hashed.filter(F.col("n") <= max_group).select(F.col("group").alias("cell"), "unit", "shingles"), None
    large = hashed.filter(F.col("n") > max_group)
    if not large.isEmpty():
        centre = cut(large.filter("central").dropDuplicates(["group"]).select("group", F.col("unit").alias("centre"), F.col("shingles").alias("with")))
        compared = cut(bounded_batches(large.join(centre, "group").select("group", "unit", "centre", "shingles", "with")).mapInArrow(near, "group long, unit long, centre long, like boolean"))
        links_ = compared.filter("like").select(F.col("unit").alias("u"), F.col("centre").alias("v"))
        rest = cut(compared.filter("not like").select("group", "unit").distinct())
        counts = cut(rest.groupBy("group").agg(F.ceil(2 * F.count(F.lit(1)) / max_group).cast("int").alias("others")))
        block = lambda n, seed: F.pmod(F.xxhash64("unit", F.lit(seed)), n).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        open_ = large.join(counts, "group").withColumn("blocks", F.ceil(2 * F.col("n") / max_group).cast("int"))
        every = open_.select("group", "unit", "shingles", block(F.col("blocks"), 1).alias("b"), upto(F.col("others")).alias("o"))
        others = open_.join(rest, ["group", "unit"], "left_semi").select("group", "unit", "shingles", block(F.col("others"), 2).alias("o"), upto(F.col("blocks")).alias("b"))
        cells = cells.union(every.unionByName(others).select(F.xxhash64("group", "b", "o").alias("cell"), "unit", "shingles"))
    pairs = bounded_batches(cells.repartition("cell").sortWithinPartitions("cell", "unit")).mapInArrow(solve, "u long, v long")
    found = components(pairs if links_ is None else pairs.union(links_))
    remove_path(docs.sparkSession, path)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, mode: Mode = NARROW, max_bucket: int = MAX_BUCKET, similarity: float | None = None) -> DataFrame:
    """One row for each row of `docs`: id, key, fp (long), component_id (the least id that can be reached over links
    within the mode's radius) and rep_key (the key of that document).

    A null or wordless text has the fingerprint 0 and is linked like any other; equal rows share a component; an empty
    table gives no rows; a null id never names a component that has another id. Texts of any length are read
    whole; a bit that exactly half the shingles set is 0. Extra columns are not read.

    With `similarity`, links within the radius give candidates only: components are then those of the pairs within a group
    of linked candidates whose shingle sets have at least that Jaccard similarity.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle, mode), "fingerprints")[0]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))).alias("first")
    distinct = cut(rows.groupBy("fp", "fp2").agg(first).withColumn("node", node()))
    if similarity is not None:
        candidates = components(links(distinct, mode, max_bucket)).withColumnRenamed("component", "group")
        text = docs.select(row_key(id_col, text_col).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content")).distinct()
        units = rows.join(text, "key").groupBy("fp", "fp2", "content").agg(F.min("key").alias("unit"), first).withColumn("node", node())
        grouped = cut(units.join(candidates, "node", "left").select("fp", "fp2", "content", "unit", "first", F.coalesce("group", "node").alias("group")))
        same = verified(docs, grouped.select("unit", "group"), id_col, text_col, shingle, similarity).withColumnRenamed("node", "unit")
        labelled = cut(grouped.join(same, "unit", "left").select("fp", "fp2", "content", "first", F.coalesce("component", "unit").alias("label")))
        least = cut(labelled.groupBy("label").agg(F.min("first").alias("rep")))  # from the shared folder, so that a join can split a large group
        best = cut(labelled.join(least, "label").select("fp", "fp2", "content", "rep"))
        named = rows.join(text, "key").join(best, ["fp", "fp2", "content"])
        return settled(named).select("id", "key", "fp", F.col("rep.id").alias("component_id"), F.col("rep.key").alias("rep_key"))
    linked = distinct.join(components(links(distinct, mode, max_bucket)), "node").select("node", "component", "first")
    linked = cut(linked)
    least = cut(linked.groupBy("component").agg(F.min("first").alias("least")))
    named = cut(distinct.join(linked.join(least, "component").select("node", "least"), "node", "left").select("fp", "fp2", F.coalesce("least", "first").alias("rep")))
    return settled(rows.join(named, ["fp", "fp2"])).select("id", "key", "fp", F.col("rep.id").alias("component_id"), F.col("rep.key").alias("rep_key"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, mode: Mode = NARROW, similarity: float | None = None) -> DataFrame:
    """One row of `docs` for each component: that of the least id. Columns stay as they are, whatever their names. Null and
    wordless texts are copies of each other; of repeated rows one stays; a row with a null id stays only if its component
    has no other; an empty table stays empty."""
    keep = cut(near_duplicates(docs, id_col, text_col, shingle, mode, similarity=similarity).groupBy(F.col("rep_key").alias("key")).agg(F.count_if(F.col("key") == F.col("rep_key")).alias("n")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    kept = whole.join(keep.select("key"), "key", "left_semi")
    if not keep.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
