"""A Merkle manifest of a dataset: a leaf for each row, a tree for each language, and one over the languages.

H is the lower-case hex SHA-256 of its inputs, one after the other, digests as hex text. Leaves are hashed by Spark's own
functions, so that no text leaves the JVM or is shuffled. They are put in order by ranges, numbered inside their language,
and dealt by blocks of 2 ** BLOCK consecutive leaves, each of which a task reduces to one node. Of these few nodes the
driver builds the upper tree, and the paths from blocks to the root (siblings, level by level) are broadcast; the tasks put
them behind the paths inside the blocks, which finishes each row's proof, and fold each row up to the root.

More than TOP nodes never come to the driver: then the nodes are leaves of another such reduction, and the paths are joined
in place of the broadcast. More than TOP languages are numbered and reduced like the leaves of one language.

A path is a string of entries of 33 bytes, from below: b'L' or b'R', where the sibling stands, and its digest; b'-' and zeros
where a node has none and is hashed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, tidy
from stellate.session import cut as cut_in_order

BLOCK, TOP = 12, 8192
SMALL = 100_000  # rows of a table that is broadcast at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ENTRY = 33
ALONE = b"-" + bytes(32)


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint that leaves the partitions and their order as they are."""
    with tidy(df.sparkSession):
        return cut_in_order(df)


def leaf_digest(*values: Column) -> Column:
    """H of the values: '-' for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos, from 0 in each group in the order given, and n, the rows of the group. No group has to fit into a task:
    rows are ranged over partitions, and those count their part of each group."""
    by = [group, *order, "_tie"]
    ranged = _cut(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))
    at = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = _cut(at.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))  # rows: partitions and groups together, at most
    whole = Window.partitionBy("_group")
    starts = parts.select(F.col("_part").alias("_p"), "_group", (F.col("_first") - F.sum("_n").over(whole.orderBy("_part")) + F.col("_n")).alias("_less"), F.sum("_n").over(whole).alias("n"))
    starts = F.broadcast(starts) if parts.count() <= SMALL else starts
    found = at.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.select(*df.columns, (F.col("_at") - F.col("_less")).alias("pos"), "n")


def in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """(lang, block, pos, n, ...) with a block's nodes one behind the other in one partition."""
    by = nodes.withColumn("block", F.shiftright("pos", block))
    return _cut(by.repartition("lang", "block").sortWithinPartitions("lang", "block", "pos"))


def levels(nodes: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The nodes (hex) and the levels above them: `height` levels, or up to a single node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([sha256(b"".join(below[i : i + 2])).hexdigest().encode() for i in range(0, len(below), 2)])
    return out


def path(tree: list[list[bytes]], i: int) -> bytes:
    """The siblings of node i of the lowest level, up to the highest."""
    out = []
    for level in tree[:-1]:
        s = i ^ 1
        out.append((b"L" if s < i else b"R") + bytes.fromhex(level[s].decode()) if s < len(level) else ALONE)
        i >>= 1
    return b"".join(out)


def fold(leaf: bytes, way: bytes) -> tuple[bytes, bytes]:
    """(root that leaf and path give, digest of the siblings)."""
    siblings = sha256()
    for k in range(0, len(way), ENTRY):
        side, other = way[k : k + 1], way[k + 1 : k + ENTRY].hex().encode()
        if side == b"-":
            leaf = sha256(leaf).hexdigest().encode()
            continue
        siblings.update(other)
        leaf = sha256(other + leaf if side == b"L" else leaf + other).hexdigest().encode()
    return leaf, siblings.hexdigest().encode()


def _each_block(batches, block: int) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """Rows of a partition of in_blocks -> (rows of a block, its levels). lang, block, pos, n and node are read."""
    held: list[pa.RecordBatch] = []
    name = None

    def done():
        rows = pa.Table.from_batches(held)
        many = rows["n"][0].as_py() > 1 << block
        return rows, levels([d.encode() for d in rows["node"].to_pylist()], block if many else None)

    for b in batches:
        keys = list(zip(b["lang"].to_pylist(), b["block"].to_pylist(), strict=True))
        at = 0
        for i, key in enumerate(keys):
            if key != name:
                if at < i:
                    held.append(b.slice(at, i - at))
                if held:
                    yield done()
                held, name, at = [], key, i
        if at < len(keys):
            held.append(b.slice(at))
    if held:
        yield done()


def _reduced(nodes: DataFrame, block: int) -> DataFrame:
    """(lang, pos, n, node): a node for each block."""

    def run(batches):
        for rows, tree in _each_block(batches, block):
            n = rows["n"][0].as_py()
            yield pa.RecordBatch.from_pylist([{"lang": rows["lang"][0].as_py(), "pos": rows["block"][0].as_py(), "n": -(-n >> block), "node": tree[-1][0].decode()}], pa.schema([("lang", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    return _cut(nodes.select("lang", "block", "pos", "n", "node").mapInArrow(run, "lang string, pos long, n long, node string"))


def _upper(nodes: DataFrame, block: int, top: int) -> tuple[DataFrame, bool]:
    """(lang, pos, path, subroot, root) for each node, and whether that is small enough to be broadcast."""
    spark = nodes.sparkSession
    got = nodes.limit(top + 1).toArrow()
    kind = "lang string, pos long, path binary, subroot string, root string"
    if got.num_rows <= top:
        langs: dict[str | None, dict[int, str]] = {}
        for r in got.to_pylist():
            langs.setdefault(r["lang"], {})[r["pos"]] = r["node"].encode()
        names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
        trees = {x: levels([langs[x][k] for k in range(len(langs[x]))]) for x in names}
        over = levels([trees[x][-1][0] for x in names]) if names else []
        rows = [(x, k, bytearray(path(trees[x], k) + path(over, i)), trees[x][-1][0].decode(), over[-1][0].decode()) for i, x in enumerate(names) for k in langs[x]]
        return spark.createDataFrame(rows, kind), True
    if not nodes.filter("n > 1").isEmpty():
        blocks = in_blocks(nodes, block)
        up, small = _upper(_reduced(blocks, block), block, top)

        def run(batches):
            for rows, tree in _each_block(batches, block):
                more = rows["path"][0].as_py()
                ways = [path(tree, i) + more for i in range(rows.num_rows)]
                first = lambda c: pa.array([rows[c][0].as_py()] * rows.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([first("lang"), rows["pos"].combine_chunks(), pa.array(ways, pa.binary()), first("subroot"), first("root")], ["lang", "pos", "path", "subroot", "root"])

        return _cut(_with_upper(blocks, up, small, block).mapInArrow(run, kind)), False
    one = numbered(nodes.select("lang", F.lit("").alias("all"), "node"), "all", ["lang"])  # more languages than `top`
    up, _ = _upper(_cut(one.select(F.col("all").alias("lang"), "pos", "n", "node")), block, top)
    joined = one.join(up.select("pos", "path", "root"), "pos")
    return joined.select("lang", F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"), False


def _with_upper(blocks: DataFrame, up: DataFrame, small: bool, block: int) -> DataFrame:
    """The first node of each block gets the block's path to the root, its subroot and the root."""
    up = up.select(F.col("lang").alias("_l"), F.col("pos").alias("_b"), "path", "subroot", "root")
    first = F.col("pos") == F.shiftleft("block", block)
    on = first & F.col("lang").eqNullSafe(F.col("_l")) & (F.col("block") == F.col("_b"))
    if small:
        return blocks.join(F.broadcast(up), on, "left").drop("_l", "_b")
    return blocks.join(up, on, "left").drop("_l", "_b").repartition("lang", "block").sortWithinPartitions("lang", "block", "pos")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", lang_col: str = "lang", block: int = BLOCK, top: int = TOP) -> DataFrame:
    """One row for each row of `docs`: id, lang, leaf, subroot, root, path (binary), proof_sha256 (H of the siblings on the
    path), folded_root and verified.

    `tampered` gives new values of fields; with them a second leaf is folded along the path of the first. Leaves of a
    language are ordered by id, null ids first, equal ids by their leaf; equal rows are leaves each, in any order, which
    is the same for all. The null language is a language of its own and comes first. Null and empty values differ; texts of
    any length are hashed whole. An only leaf is its subroot, an only subroot the root. An empty table gives no rows.
    Columns that aren't fields are not read.
    """
    own = [F.col(f) for f in fields]
    changed = [(tampered or {}).get(f, F.col(f)) for f in fields]
    leaf = leaf_digest(*own)
    other = leaf_digest(*changed) if tampered else F.lit(None).cast("string")
    differs = F.lit(False)
    for a, b in zip(own, changed, strict=True):
        differs = differs | ~a.cast("string").eqNullSafe(b.cast("string"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), leaf.alias("node"), F.when(differs, other).alias("other"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = in_blocks(numbered(rows, "lang", ["id", "node"]), block)
    up, small = _upper(_reduced(blocks, block), block, top)

    def run(batches):
        for rows, tree in _each_block(batches, block):
            more, subroot, root = (rows[c][0].as_py() for c in ("path", "subroot", "root"))
            ways, proofs, roots = [], [], []
            for i, other in enumerate(rows["other"].to_pylist()):
                ways.append(path(tree, i) + more)
                r, p = fold(other.encode() if other else tree[0][i], ways[-1])
                proofs.append(p.decode())
                roots.append(r.decode())
            n = rows.num_rows
            cols = [rows["id"].combine_chunks(), rows["lang"].combine_chunks(), rows["node"].combine_chunks(), pa.array([subroot] * n), pa.array([root] * n), pa.array(ways, pa.binary()), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "lang", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"])

    out = bounded_batches(_with_upper(blocks, up, small, block)).mapInArrow(run, f"id {kind}, lang string, leaf string, subroot string, root string, path binary, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnsRenamed({"id": id_col, "lang": lang_col})


def one_more(docs: DataFrame, id_col: str = "doc_id", count_col: str = "n_chars", every: int = 7) -> dict[str, Column]:
    """A change for `manifest`: one is added to the count of the rows of which `every` divides the CRC of the id; nulls
    stay. Wider than a long, so that the largest one has a successor."""
    hit = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    return {count_col: F.when(hit, F.col(count_col).cast("decimal(20,0)") + 1).otherwise(F.col(count_col).cast("decimal(20,0)"))}
