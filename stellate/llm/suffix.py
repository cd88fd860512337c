"""Suffix-array dedup: removal of every byte that a repeated string of `length` bytes covers.

Suffixes are induced, not sorted one by one. Anchors are positions that hold the least hash of some `window` grams (the
last of equal ones), so that equal windows of text have equal anchors at equal places; each string of `floor` bytes
belongs to the anchor among its first `window` positions. The strings of one anchor form a family: a span of text
around the anchor, whose core all of them hold. Only families whose core occurs twice can hold a repeat; of those, equal
families are repeated as a whole, and different families of one core are compared in a shard by induced sorting (see
induced.py): the suffixes at the anchors are sorted, and from these the suffixes to the left are induced byte by byte by
tuples that pass a queue and carry common prefixes along. With the limits below a shard fits into memory; only with a smaller
MEMORY are its runs on disk, merged by a heap.

A core with more than `hot` different families would be one task's work. Its families are divided by recursion: into
families of an eighth of the window, whose cores are longer, grouped and compared in the same way, down to a window
of one, where a family is one string.

`floor` may be less than `length`: strings of `length` bytes are found among those whose first `floor` bytes repeat, and
the bytes that the shorter strings cover are known as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes, cut, remove_path, row_key, settled, written
from stellate.llm.induced import MEMORY, Shard

#: FLOOR: passages of over 50 words; fewer than one in a thousand are shorter in the test data.
LENGTH, FLOOR, WINDOW, GRAM = 400, 200, 96, 8
HOT = 1_000
DIVIDE = 8
SHARD_ROWS = 20_000
BLOCK = 4 << 20


def _least(buf: np.ndarray, window: int) -> np.ndarray:
    """For each start the position of the least gram hash among `window` grams, the last of equal ones."""
    n = len(buf) - GRAM + 1
    grams = np.empty(n, np.uint64)
    for k in range(min(GRAM, n)):
        m = (n - k + GRAM - 1) // GRAM
        grams[k::GRAM] = np.frombuffer(buf[k : k + GRAM * m].tobytes(), "<u8")
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64(0xFFFFFFFF)
    grams &= ~low
    grams |= low - np.arange(n, dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        grams = np.minimum(grams[:-step], grams[step:])
        width += step
    return (low - (grams & low)).astype(np.int64)


def families(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For texts that lie in a row in buf: (text, anchor, first, last), the starts of each family's strings."""
    out = [[], [], [], []]
    per = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(per)), per)
    if not len(text):
        return tuple(np.empty(0, np.int64) for _ in out)
    start = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offsets[:-1], per)
    anchor = np.empty(len(start), np.int64)
    for at in range(0, len(buf), BLOCK):
        i, j = np.searchsorted(start, [at, at + BLOCK])
        if i < j:
            found = _least(buf[at : at + BLOCK + window + GRAM - 2], window)
            anchor[i:j] = found[start[i:j] - at] + at
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return text[new], anchor[new], start[new], start[last]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row, and where each value begins (with the end)."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_CORE = "core long, n long"
_FAMILY = "core long, fam long, key long, lo int, left short, span short, size short"


def _located(floor: int, window: int):
    """For the batches of (key, text): keys, bytes, and of each family the text, anchor, first and last start and core."""
    core = floor - window + 1

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in by_bytes(batches, "text", BLOCK):
            buf, offsets = _flat(b.column(1))
            text, anchor, lo, hi = families(buf, offsets, floor, window)
            if len(text):
                raw = memoryview(buf)
                cores = np.array([xxh3_64_intdigest(raw[a : a + core]) for a in anchor.tolist()], np.uint64).view(np.int64)
                yield b.column(0).to_numpy(), raw, offsets, text, anchor, lo, hi, cores

    return run


def _count(floor: int, window: int):
    def run(batches):
        for *_, cores in _located(floor, window)(batches):
            known, n = np.unique(cores, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n.astype(np.int64))], ["core", "n"])

    return run


def _find(floor: int, length: int, window: int):
    def run(batches):
        from xxhash import xxh3_64_intdigest

        for keys, raw, offsets, text, anchor, lo, hi, cores in _located(floor, window)(batches):
            ends = np.minimum(hi + length, offsets[text + 1])
            seeds = ((anchor - lo) << 20 | (hi - lo)).tolist()
            whole = np.array([xxh3_64_intdigest(raw[i:j], s) for i, j, s in zip(lo.tolist(), ends.tolist(), seeds, strict=True)], np.uint64).view(np.int64)
            short = lambda x: pa.array(x.astype(np.int16))
            cols = [pa.array(cores), pa.array(whole), pa.array(keys[text]), pa.array((lo - offsets[text]).astype(np.int32)), short(anchor - lo), short(hi - lo), short(ends - lo)]
            yield pa.RecordBatch.from_arrays(cols, ["core", "fam", "key", "lo", "left", "span", "size"])

    return run


_BODY = "core long, fam long, left short, span short, m long, bytes binary"
_RANGE = "core long, fam long, j1 int, j2 int, level int"


def _runs(classes: np.ndarray, core: np.ndarray, fam: np.ndarray) -> pa.RecordBatch:
    """Runs of starts of one class, other than 0, of each family."""
    change = np.diff(np.pad(classes, ((0, 0), (1, 1))).astype(np.int16), axis=1) != 0
    r, a = np.nonzero(change[:, :-1] & (classes > 0))
    b = np.nonzero(change[:, 1:] & (classes > 0))[1]
    return pa.RecordBatch.from_arrays([pa.array(core[r]), pa.array(fam[r]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(classes[r, a].astype(np.int32))], ["core", "fam", "j1", "j2", "level"])


def _own(size: np.ndarray, span: np.ndarray, length: int, wide: int) -> np.ndarray:
    """The classes of a family that occurs twice: 2 where `length` bytes follow, else 1; 0 beyond its starts."""
    j = np.arange(wide)
    return np.where(j <= span[:, None], 1 + (j + length <= size[:, None]), 0).astype(np.uint8)


def _sort_shards(floor: int, length: int, rows: int, memory: int):
    """Bodies sorted by core -> ranges: the repeated strings. A core is never divided between shards."""

    def solve(shard, core, fam, m):
        core, fam, m = (np.concatenate(x) for x in (core, fam, m))
        for a, classes in shard.classes():
            k = slice(a, a + len(classes))
            own = _own(shard.size[k], shard.span[k], length, classes.shape[1])
            yield _runs(np.where(m[k, None] > 1, own, classes), core[k], fam[k])

    def run(batches: Iterator[pa.RecordBatch]):
        shard, parts = Shard(floor, length, memory), ([], [], [])
        for b in batches:
            core, fam, left, span, m = (b.column(i).to_numpy() for i in range(5))
            data, offsets = _flat(b.column(5))
            at = 0
            if shard.rows >= rows and len(core):
                at = int(np.searchsorted(core, parts[0][-1][-1], "right"))
            for i, j in ((0, at), (at, len(core))):
                if i < j:
                    if i == at and shard.rows >= rows:
                        yield from solve(shard, *parts)
                        shard, parts = Shard(floor, length, memory), ([], [], [])
                    shard.add(data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1]), left[i:j], span[i:j])
                    for x, y in zip(parts, (core, fam, m), strict=True):
                        x.append(y[i:j].copy())
        if shard.rows:
            yield from solve(shard, *parts)

    return run


def _contents(length: int):
    """Documents with lists of families -> the families with their bytes."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column(1)
                of = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                s = lists.flatten()
                lo, size = s.field("lo").to_numpy(), s.field("size").to_numpy()
                texts = part.column(0).to_pylist()
                raw = [texts[d][x : x + n] for d, x, n in zip(of.tolist(), lo.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(s.field(c) for c in ("core", "fam", "left", "span", "m", "k")), pa.array(raw, pa.binary())], ["core", "fam", "left", "span", "m", "k", "bytes"])

    return run


_PART = "core long, fam long, left short, span short, m long, bytes binary, of_core long, of_fam long, shift int"


def _divide(floor: int, length: int, step: int):
    """Bodies -> the families of `step` starts that they consist of, with longer cores, and where they belong."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            out = []
            for core, fam, left, span, m, raw in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for block in range((left - span) // step, left // step + 1):
                    near, far = left - block * step, left - block * step - step + 1  # the starts at the block's ends; the first is the new anchor
                    first, last = max(0, far), min(span, near)
                    inner = xxh3_64_intdigest(raw[near : far + floor], (core + 31 * block) & 0xFFFFFFFFFFFFFFFF)
                    body = raw[first : last + length]
                    whole = xxh3_64_intdigest(body, (near - first) << 20 | (last - first))
                    out.append((inner, whole, near - first, last - first, m, body, core, fam, first))
                if len(out) >= 4096:
                    yield _parts(out)
                    out = []
            if out:
                yield _parts(out)

    return run


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    cols = [signed(c[0]), signed(c[1]), pa.array(c[2], pa.int16()), pa.array(c[3], pa.int16()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary()), pa.array(c[6], pa.int64()), pa.array(c[7], pa.int64()), pa.array(c[8], pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["core", "fam", "left", "span", "m", "bytes", "of_core", "of_fam", "shift"])


def _counted(group: DataFrame) -> DataFrame:
    """Families with k, the number of different ones of their core. Both sides are read from the shared folder, so that
    the partitions of a core with many can be split."""
    several = cut(group.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    return cut(group.join(several, "core", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long"))))


def _alone(group: DataFrame, length: int) -> DataFrame:
    """The ranges of families that occur twice and have their core to themselves."""
    own = group.filter("k = 1 and m > 1")
    full = F.least(F.col("span").cast("int"), F.col("size") - length)  # the last start with `length` bytes
    at = lambda a, b, level: F.struct(a.cast("int").alias("j1"), b.cast("int").alias("j2"), F.lit(level).alias("level"))
    both = F.array(at(F.lit(0), full, 2), at(F.greatest(full + 1, F.lit(0)), F.col("span"), 1))
    return own.select("core", "fam", F.explode(F.filter(both, lambda x: x["j1"] <= x["j2"])).alias("r")).select("core", "fam", "r.*")


def _compared(bodies: DataFrame, floor: int, length: int, window: int, hot: int, rows: int, memory: int, made: list[str]) -> DataFrame:
    """bodies with k > 1 -> ranges. Paths of tables that are still read are added to `made`."""
    if window == 1:  # a family is a string: the core is its first `floor` bytes, which another family shares
        level = F.when((F.col("m") > 1) & (F.length("bytes") >= length), 2).otherwise(1 if floor < length else 2)
        return bodies.select("core", "fam", F.lit(0).alias("j1"), F.lit(0).alias("j2"), level.alias("level"))
    bodies, path = written(bodies, "bodies")
    made.append(path)
    easy, many = bodies.filter(F.col("k") <= hot).drop("k"), bodies.filter(F.col("k") > hot).drop("k")
    ranges = bounded_batches(easy.repartition("core").sortWithinPartitions("core")).mapInArrow(_sort_shards(floor, length, rows, memory), _RANGE)
    if many.isEmpty():
        return ranges
    step = max(1, window // DIVIDE)
    parts, path = written(bounded_batches(many.select("core", "fam", "left", "span", "m", "bytes")).mapInArrow(_divide(floor, length, step), _PART), "parts")
    made.append(path)
    group = parts.groupBy("core", "fam").agg(F.sum("m").alias("m"), F.first("left").alias("left"), F.first("span").alias("span"), F.first("bytes").alias("bytes"))
    group = _counted(cut(group.withColumn("size", F.length("bytes"))))
    inner = _compared(group.filter("k > 1").select("core", "fam", "left", "span", "m", "k", "bytes"), floor, length, step, hot, rows, memory, made)
    found = cut(_alone(group, length).union(inner))
    back = parts.select("core", "fam", "of_core", "of_fam", "shift").join(found, ["core", "fam"])
    return ranges.union(back.select(F.col("of_core").alias("core"), F.col("of_fam").alias("fam"), (F.col("j1") + F.col("shift")).alias("j1"), (F.col("j2") + F.col("shift")).alias("j2"), "level"))


def repeated_intervals(keyed: DataFrame, length: int = LENGTH, floor: int | None = None, window: int | None = None, hot: int = HOT, shard_rows: int = SHARD_ROWS, memory: int = MEMORY) -> DataFrame:
    """keyed (key, text binary) -> (key, spans: array of (start, end, level)), the byte ranges that repeated strings cover:
    level 2 those of `length` bytes, level 1 those of `floor` bytes (`length` if it isn't given) beside them. A document
    without any is absent. Ranges of one document may overlap; their number is bounded by its size."""
    floor = length if floor is None else floor
    window = max(1, min(WINDOW, floor // 2)) if window is None else window
    if window + GRAM - 1 > floor or window < 1 or floor > length:
        raise ValueError("a window and a gram must fit into the floor, and the floor into the length")
    spark = keyed.sparkSession
    src = bounded_batches(keyed.select("key", "text"))
    twice = cut(src.mapInArrow(_count(floor, window), _CORE).groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1").select("core"))
    cand, path = written(settled(src.mapInArrow(_find(floor, length, window), _FAMILY).join(twice, "core", "left_semi")), "repeats")
    made = [path]
    group = cut(cand.groupBy("core", "fam").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "lo", "left", "span", "size")).alias("rep")))
    group = _counted(group.select("core", "fam", "m", "rep.*"))
    wanted = group.filter("k > 1").groupBy("key").agg(F.collect_list(F.struct("core", "fam", "left", "span", "m", "k", "lo", "size")).alias("wanted"))
    bodies = bounded_batches(keyed.join(wanted.hint("shuffle_hash"), "key").select("text", "wanted")).mapInArrow(_contents(length), "core long, fam long, left short, span short, m long, k long, bytes binary")
    ranges = cut(_alone(group, length).union(_compared(bodies, floor, length, window, hot, shard_rows, memory, made)))
    start = F.col("lo") + F.col("j1")
    end = F.col("lo") + F.col("j2") + F.when(F.col("level") == 2, length).otherwise(floor)
    hits = cand.join(ranges, ["core", "fam"]).select("key", F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.col("level").cast("long").alias("level")).alias("span"))
    found = cut(hits.groupBy("key").agg(F.collect_list("span").alias("spans")))
    for path in made:
        remove_path(spark, path)
    return found


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges from (start, end) rows; ranges that touch become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:], [len(spans)]]) - 1]], axis=1)


def _removal(batches):
    """(id, text, spans) -> (id, n_bytes, n_removed, n_spans, n_repeated, kept)"""
    for whole in batches:
        for b in by_bytes([whole], "text"):
            lists = b.column(2)
            rows = []
            flat = lists.flatten()
            triples = np.stack([flat.field(c).to_numpy() for c in ("start", "end", "level")], axis=1) if len(flat) else np.empty((0, 3), np.int64)
            at = np.concatenate([[0], np.cumsum([n or 0 for n in pc.list_value_length(lists).to_pylist()])]).astype(int)
            for i, t in enumerate(b.column(1).to_pylist()):
                mine = triples[at[i] : at[i + 1]]
                if not len(mine):
                    rows.append((len(t or b""), 0, 0, 0, t))
                    continue
                covered = int(np.diff(_merged(mine[:, :2]), axis=1).sum())
                mine = mine[mine[:, 2] == 2]
                spans = _merged(mine[:, :2]).tolist() if len(mine) else []
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(t[x:y] for x, y in zip(ends, [*(s for s, _ in spans), len(t)], strict=True)) if spans else t
                rows.append((len(t), len(t) - len(kept), len(spans), covered, kept))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept"])


def _hashed(batches):
    for b in _removal(batches):
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([hashlib.sha256(t).hexdigest() for t in b.column(5).to_pylist()])], ["id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, floor: int | None = None, digest: bool = False, **limits) -> DataFrame:
    """One row for each row of `docs`: the id, n_bytes, n_removed, n_spans (maximal removed runs), n_repeated (the bytes
    that repeated strings of `floor` bytes cover; `length` if it isn't given) and kept, the bytes that are left, or with
    `digest` their kept_sha256.

    Texts are UTF-8 bytes; a null text is empty and matches nothing. Repeated rows repeat each other, so that all their
    strings go. A text shorter than `length` loses nothing; texts of any length are read whole, in blocks; an empty table
    gives no rows. Which of equal strings came first plays no part, as all go. Extra columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_intervals(keyed, length, floor, **limits)
    kind = keyed.schema["id"].dataType.simpleString()
    src = keyed.join(spans.hint("shuffle_hash"), "key", "left").select("id", "text", "spans")
    if digest:
        out = bounded_batches(src).mapInArrow(_hashed, f"id {kind}, n_bytes long, n_removed long, n_spans long, n_repeated long, kept_sha256 string")
    else:
        out = bounded_batches(src).mapInArrow(_removal, f"id {kind}, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")
    return out.withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **limits) -> DataFrame:
    """`docs` with repeated strings cut out of the texts (characters cut in part go too) and n_chars, if it is there,
    counted anew; documents of which only white space is left are dropped. The columns stay as they are, whatever their
    names. A null text stays null; repeated rows repeat each other; of an empty table nothing is left."""
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_intervals(keyed, length, **limits)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text_col).cast("binary").alias("text"), row_key(id_col, text_col).alias("key"))
    src = rows.join(spans.hint("shuffle_hash"), "key", "left").select("rest", "text", "spans")
    kind = src.schema["rest"].dataType.simpleString()

    def run(batches):
        for b in _removal(batches):
            kept = [None if t is None else t.decode("utf-8", "ignore") for t in b.column(5).to_pylist()]
            hit = [n > 0 for n in b.column(2).to_pylist()]
            live = [not h or bool(t.split()) for h, t in zip(hit, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(hit)], ["rest", "text", "hit"]).filter(pa.array(live))

    out = bounded_batches(src).mapInArrow(run, f"rest {kind}, text string, hit boolean")
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
