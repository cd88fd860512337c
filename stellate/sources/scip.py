"""SCIP indexes: a reader of the protobuf wire format and a Spark data source.

An index is a row of messages, each with its length before it, that can only be followed from the first on. To read one
large index in many tasks it is framed first, without decoding: each task takes every byte of its chunk that could begin a
message for a beginning, and follows all these chains at once to where they leave the chunk; a chain that meets no message
is dropped. Of the few that are left the driver follows the one that begins the file, from chunk to chunk. Then each task
knows where the first message of its chunk begins, cuts out those that lie in it whole, and decodes them; only messages
over the border of chunks are put together by a shuffle.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate import schema
from stellate.session import cut
from stellate.sources import raw

_DOCUMENT = "doc_ord long, doc string, occurrences array<struct<symbol string, symbol_roles int, line int, enc_start int, enc_end int, occ_ord long>>, symbols array<struct<symbol string, display_name string, sym_ord long, relationships array<struct<symbol string, is_implementation boolean>>>>"


def _varint(buf: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = buf[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def fields(buf: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(field number, wire type, value) of a message."""
    at, end = 0, len(buf)
    while at < end:
        tag, at = _varint(buf, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            n, at = _varint(buf, at)
            if at + n > end:
                raise ValueError("a message ends too early")
            value, at = buf[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = buf[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield number, kind, value


def _ints(kind: int, value) -> list[int]:
    """Packed or single int32 values."""
    if kind == 0:
        return [_signed(value)]
    out, at = [], 0
    while at < len(value):
        v, at = _varint(value, at)
        out.append(_signed(v))
    return out


def _signed(v: int) -> int:
    v &= 0xFFFFFFFFFFFFFFFF
    return v - (1 << 64) if v >> 63 else v


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _lines(buf: memoryview, single: bool) -> tuple[int, int]:
    """(start line, end line) of a single- or multi-line range message."""
    got = {n: _signed(v) for n, kind, v in fields(buf) if kind == 0}
    start = got.get(1, 0)
    return start, start if single else got.get(3, 0)


#: Field numbers of the format.
_RANGE, _SYMBOL, _ROLES, _ENCLOSING = 1, 2, 3, 7
_POSITIONS = 6
_SINGLE, _MULTI, _SINGLE_ENCLOSING, _MULTI_ENCLOSING = 8, 9, 10, 11


def occurrence(buf: memoryview) -> dict:
    """Typed ranges win over packed ones; without any range the line is None."""
    symbol, roles, packed, around = "", 0, [], []
    line = enclosing = None
    for n, kind, v in fields(buf):
        if n == _RANGE:
            packed += _ints(kind, v)
        elif n == _SYMBOL:
            symbol = _text(v)
        elif n == _ROLES:
            roles = _signed(v)
        elif n == _ENCLOSING:
            around += _ints(kind, v)
        elif n in (_SINGLE, _MULTI):
            line = _lines(v, n == _SINGLE)[0]
        elif n in (_SINGLE_ENCLOSING, _MULTI_ENCLOSING):
            enclosing = _lines(v, n == _SINGLE_ENCLOSING)
    if line is None and packed:
        line = packed[0]
    if enclosing is None and around:
        enclosing = (around[0], around[2] if len(around) >= 4 else around[0])
    start, end = enclosing or (None, None)
    return {"symbol": symbol, "symbol_roles": roles, "line": line, "enc_start": start, "enc_end": end}


def document(buf: memoryview) -> dict:
    path, occurrences, symbols = "", [], []
    for n, _, v in fields(buf):
        if n == 1:
            path = _text(v)
        elif n == 2:
            occurrences.append(occurrence(v) | {"occ_ord": len(occurrences)})
        elif n == 3:
            s = {"symbol": "", "display_name": "", "sym_ord": len(symbols), "relationships": []}
            for k, _, w in fields(v):
                if k == 1:
                    s["symbol"] = _text(w)
                elif k == 6:
                    s["display_name"] = _text(w)
                elif k == 4:
                    r = {"symbol": "", "is_implementation": False}
                    for j, _, x in fields(w):
                        if j == 1:
                            r["symbol"] = _text(x)
                        elif j == 3:
                            r["is_implementation"] = bool(x)
                    s["relationships"].append(r)
            symbols.append(s)
    return {"doc": path, "occurrences": occurrences, "symbols": symbols}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(n: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(n << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(n << 3 | 2) + _number(len(value)) + value


def encoded(path: str, occurrences: list[dict], symbols: list[dict]) -> bytes:
    """A document as it lies in an index: what `document` reads, with its tag and length before it. Its last byte is
    always the encoding of positions."""
    parts = [_field(1, path)]
    for o in occurrences:
        one = _field(_SYMBOL, o["symbol"]) + _field(_ROLES, o["symbol_roles"])
        if o["line"] is not None:
            one += _field(_RANGE, _number(o["line"]) + _number(0) + _number(1))
        if o["enc_start"] is not None:
            one += _field(_ENCLOSING, b"".join(map(_number, (o["enc_start"], 0, o["enc_end"], 1))))
        parts.append(_field(2, one))
    for s in symbols:
        parts.append(_field(3, _field(1, s["symbol"]) + (_field(6, s["display_name"]) if s["display_name"] else b"") + b"".join(_field(4, _field(1, r["symbol"]) + _field(3, int(r["is_implementation"]))) for r in s["relationships"])))
    return _field(2, b"".join(parts) + _field(_POSITIONS, 1))


HELD = 1 << 20  # bytes of documents whose objects a task holds at once, and always one document


def _one_by_one(batch) -> Iterator[dict]:
    """The rows of a batch, of which one at a time is made of Python's objects: a batch holds thousands of documents."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _encoded(batches):
    """Rows of documents (doc, o, s) -> (body): each as it lies in an index, without its last byte."""
    import pyarrow as pa

    def written(bodies):
        return pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], ["body"])

    for b in batches:
        bodies, held = [], 0
        for x in _one_by_one(b):
            bodies.append(encoded(x["doc"], x["o"], x["s"] or [])[:-1])
            held += len(bodies[-1])
            if held > HELD:
                yield written(bodies)
                bodies, held = [], 0
        if bodies:
            yield written(bodies)


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """An index of occurrences, symbol_info and relationships: a folder of files, documents in order over them. They are
    encoded and written in tasks."""
    o = index["occurrences"].groupBy("doc_ord", "doc").agg(F.sort_array(F.collect_list(F.struct("occ_ord", "symbol", "symbol_roles", "line", "enc_start", "enc_end"))).alias("o"))
    r = index["relationships"].groupBy("doc_ord", F.col("src").alias("symbol")).agg(F.sort_array(F.collect_list(F.struct("rel_ord", F.col("dst").alias("symbol"), "is_implementation"))).alias("relationships"))
    s = index["symbol_info"].join(r, ["doc_ord", "symbol"], "left").groupBy("doc_ord").agg(F.sort_array(F.collect_list(F.struct("sym_ord", "symbol", "display_name", F.coalesce("relationships", F.array().cast("array<struct<rel_ord:bigint,symbol:string,is_implementation:boolean>>")).alias("relationships")))).alias("s"))
    docs = o.join(s, "doc_ord", "left").orderBy("doc_ord")

    raw.write_parts(docs.mapInArrow(_encoded, "body binary"), path, "\x01")


def metadata(buf: memoryview) -> dict:
    out = {"project_root": None, "tool": None, "tool_version": None}
    for n, _, v in fields(buf):
        if n == 2:
            for k, _, w in fields(v):
                if k in (1, 2):
                    out["tool" if k == 1 else "tool_version"] = _text(w)
        elif n == 3:
            out["project_root"] = _text(v)
    return out


#: Tags of an index's own fields, and the longest header of a message.
_TAGS, _HEADER = (0x0A, 0x12, 0x1A), 11
CHUNK = 4 << 20
CHAINS = 2_000_000  # beginnings that are left by all chunks together and come to the driver at most


def chains(body: bytes, offset: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(beginning, end, messages, documents): for each place of a chunk where messages could begin, where a chain of them
    from there leaves the chunk, or comes so near to its end that a header may not be in it whole."""
    a = np.frombuffer(body, np.uint8)
    core = max(0, len(a) - _HEADER)
    tag = np.zeros(256, bool)
    tag[list(_TAGS)] = True
    at = np.flatnonzero(tag[a[:core]])
    length, more, n = np.zeros(len(at), np.int64), np.ones(len(at), bool), np.zeros(len(at), np.int64)
    for k in range(1, 6):
        byte = a[at + k].astype(np.int64)
        length += np.where(more, (byte & 0x7F) << 7 * (k - 1), 0)
        n += more
        more &= byte >= 0x80
    end = at + 1 + n + length
    alive = ~more & (end + offset <= size)
    place = np.full(core + 1, -1, np.int32)
    place[at] = np.arange(len(at))
    count, docs = np.ones(len(at), np.int64), (a[at] == 0x12).astype(np.int64)
    while True:
        inside = np.flatnonzero(alive & (end < core))
        if not len(inside):
            break
        j = place[end[inside]]
        alive[inside[j < 0]] = False
        i, j = inside[j >= 0], j[j >= 0]
        end[i], count[i], docs[i], alive[i] = end[j], count[i] + count[j], docs[i] + docs[j], alive[j]
    return at[alive] + offset, end[alive] + offset, count[alive], docs[alive]


def header(head: bytes) -> tuple[int, int] | None:
    """(tag, bytes of the whole message) from its first bytes; None for what isn't a message of an index."""
    if not head or head[0] not in _TAGS:
        return None
    try:
        n, at = _varint(memoryview(head), 1)
    except (IndexError, ValueError):
        return None
    return head[0], at + n


def _chained(chunks: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(file, offset, length, head, tail, begins, ends, counts, docs): a row for each chunk."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for file, offset, body in (x.values() for x in _one_by_one(b.select(["file", "offset", "body"]))):
                got = chains(body, offset, sizes[file])
                cols = [pa.array([file]), pa.array([offset], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([body[:_HEADER]], pa.binary()), pa.array([body[-_HEADER:]], pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in got)]
                yield pa.RecordBatch.from_arrays(cols, ["file", "offset", "length", "head", "tail", "begins", "ends", "counts", "docs"])

    return chunks.select("file", "offset", "body").mapInArrow(run, "file string, offset long, length long, head binary, tail binary, begins array<long>, ends array<long>, counts array<long>, docs array<long>")


def _followed(rows: list, size: int) -> tuple[list[tuple[int, int | None, int]], int] | None:
    """Chunks of one file in order -> ([(offset, first message or None, its number)], documents), None where the chain breaks."""
    offsets = [r["offset"] for r in rows]
    ways = {p: x for r in rows for p, *x in zip(r["begins"], r["ends"], r["counts"], r["docs"], strict=True)}
    out, at, n, docs, done = [], 0, 0, 0, 0

    def reach(to: int):
        """Chunks up to the one that holds `to`, whose first message from outside is there."""
        nonlocal done
        while done < len(rows) and offsets[done] + rows[done]["length"] <= to:
            out.append((offsets[done], None, n))
            done += 1
        if done < len(rows):
            out.append((offsets[done], to, n))
            done += 1

    reach(0)
    while at < size:
        k = bisect.bisect_right(offsets, at) - 1
        if at in ways:
            at, m, d = ways[at]
        else:  # near the end of a chunk, where the header may go on in the next
            r = rows[k]
            near = at - (r["offset"] + r["length"] - len(r["tail"]))
            head = bytes(r["tail"])[near:] if near >= 0 else b""
            for later in rows[k + 1 :]:
                if len(head) >= _HEADER:
                    break
                head += bytes(later["head"])
            got = header(head)
            if got is None or at + got[1] > size:
                return None
            at, m, d = at + got[1], 1, int(got[0] == 0x12)
        n, docs = n + m, docs + d
        if at < size and (done == 0 or at >= offsets[done - 1] + rows[done - 1]["length"]):
            reach(at)
    while done < len(rows):
        out.append((offsets[done], None, n))
        done += 1
    return out, docs


def frame(spark: SparkSession, path: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None, list[str], dict[str, int]]:
    """(chunks, plan of the chunks of well-formed files, files that have to be read in order, documents of each file)."""
    sizes = dict(raw.files_at(spark, path))
    chunks = raw.chunks(spark, path, chunk)
    found = cut(_chained(chunks, sizes))
    left = found.agg(F.sum(F.size("begins"))).first()[0] or 0
    files: dict[str, list] = {}
    for r in found.orderBy("file", "offset").collect() if left <= CHAINS else []:
        files.setdefault(r["file"], []).append(r)
    plan, slow, docs = [], [f for f, size in sizes.items() if size and f not in files], {f: 0 for f in sizes}
    for f, rows in files.items():
        got = _followed(rows, sizes[f])
        if got is None:
            slow.append(f)
        else:
            plan += [(f, *x) for x in got[0]]
            docs[f] = got[1]
    return chunks, spark.createDataFrame(plan, "file string, offset long, first long, number long") if plan else None, slow, docs


def _in_order(batches):
    """Chunks of whole files in order -> (file, number, at, whole, message), however their messages are numbered; for files
    with fields of their own at the top."""
    import pyarrow as pa

    name, held, number, start = None, b"", 0, 0

    def messages(buf: bytes, last: bool):
        nonlocal held, number, start
        at = 0
        while at < len(buf):
            try:
                got = next(_framed(memoryview(buf)[at : at + (1 << 20)] if not last else memoryview(buf)[at:]))
            except (IndexError, ValueError):
                if last or len(buf) - at > 1 << 31:
                    raise ValueError("a message ends too early") from None
                break
            kind, wire, body, n = got
            if n > len(buf) - at:
                if last:
                    raise ValueError("a message ends too early")
                break
            if wire == 2 and kind in (1, 2):
                yield name, number, start + at, True, buf[at : at + n]
            number, at = number + 1, at + n
        held, start = buf[at:], start + at

    for b in batches:
        rows = []
        for file, body in zip(b["file"].to_pylist(), b["body"].to_pylist(), strict=True):
            if file != name:
                if held:
                    raise ValueError("a message ends too early")
                name, held, number, start = file, b"", 0, 0
            rows += messages(held + body, False)
        if rows:
            yield _pieces(pa, rows)
    if held:
        raise ValueError("a message ends too early")


def _framed(buf: memoryview) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, where the body begins, bytes of the whole field) of the first field of a buffer that may be cut off."""
    tag, at = _varint(buf, 0)
    kind, wire = tag >> 3, tag & 7
    if wire == 0:
        yield kind, wire, at, _varint(buf, at)[1]
    elif wire == 2:
        n, at = _varint(buf, at)
        yield kind, wire, at, at + n
    elif wire in (1, 5):
        yield kind, wire, at, at + (8 if wire == 1 else 4)
    else:
        raise ValueError(f"wire type {wire}")


def _cut_out(batches):
    """Chunks with the place and number of their first message -> (file, number, at, whole, message or a part of it)"""
    import pyarrow as pa

    for b in batches:
        for file, offset, body, first, number in (x.values() for x in _one_by_one(b.select(["file", "offset", "body", "first", "number"]))):
            end = offset + len(body)
            at = end if first is None else first
            rows, held = [], 0
            if at > offset:
                rows.append((file, number - 1, offset, False, body[: at - offset]))
            while at < end:
                got = header(body[at - offset : at - offset + _HEADER])
                n = got[1] if got and at + got[1] <= end else None
                rows.append((file, number, at, n is not None, body[at - offset : at - offset + n] if n else body[at - offset :]))
                number, at = number + 1, at + n if n else end
                held += len(rows[-1][4])
                if held > 4 << 20:
                    yield _pieces(pa, rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(pa, rows)


_PIECES = "file string, number long, at long, whole boolean, body binary"


def _pieces(pa, rows):
    a, b, c, d, e = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d), pa.array(e, pa.binary())], ["file", "number", "at", "whole", "body"])


def messages(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, number, body): the top-level messages of the indexes at `path` that are documents or metadata, header and all,
    numbered in their file."""
    chunks, plan, slow, _ = frame(spark, path, chunk)
    out = spark.createDataFrame([], "file string, number long, body binary")
    if plan is not None:
        plan = cut(plan)
        few = plan.count() <= raw.SMALL
        placed = chunks.join(F.broadcast(plan) if few else plan, ["file", "offset"])
        pieces = placed.select("file", "offset", "body", "first", "number").mapInArrow(_cut_out, _PIECES)
        # parts of messages over the border of chunks; a chunk gives two of them at most
        parts = pieces.filter("not whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("p"))
        joined = parts.select("file", "number", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["body"])).alias("body"))
        out = pieces.filter("whole").select("file", "number", "body").union(joined)
    if slow:
        ordered = chunks.filter(F.col("file").isin(slow)).select("file", "offset", "body").repartition("file").sortWithinPartitions("file", "offset")
        out = out.union(ordered.mapInArrow(_in_order, _PIECES).select("file", "number", "body"))
    return out.filter(F.substring("body", 1, 1).isin(F.lit(b"\x0a"), F.lit(b"\x12")))


def body_of(message: bytes) -> memoryview:
    """A message without its tag and length."""
    _, at = _varint(memoryview(message), 1)
    return memoryview(message)[at:]


def _decoded(batches):
    """(ord, body) of messages of documents -> _DOCUMENT."""
    import pyarrow as pa

    relationship = pa.struct([("symbol", pa.string()), ("is_implementation", pa.bool_())])
    occurrences = pa.list_(pa.struct([("symbol", pa.string()), ("symbol_roles", pa.int32()), ("line", pa.int32()), ("enc_start", pa.int32()), ("enc_end", pa.int32()), ("occ_ord", pa.int64())]))
    symbols = pa.list_(pa.struct([("symbol", pa.string()), ("display_name", pa.string()), ("sym_ord", pa.int64()), ("relationships", pa.list_(relationship))]))
    columns = {"doc_ord": pa.int64(), "doc": pa.string(), "occurrences": occurrences, "symbols": symbols}

    def decoded(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in columns.items()], list(columns))

    for b in batches:
        rows, held = [], 0
        for x in _one_by_one(b):
            rows.append(document(body_of(x["body"])) | {"doc_ord": x["ord"]})
            held += len(x["body"])
            if held > HELD:
                yield decoded(rows)
                rows, held = [], 0
        if rows:
            yield decoded(rows)


def read_documents(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each document of the indexes at `path`, decoded where its bytes were read. Documents are numbered by the
    path of their index, then by their place in it."""
    order = spark.createDataFrame([(p, k << 40) for k, (p, _) in enumerate(raw.files_at(spark, path))], "file string, base long")
    order = F.broadcast(order) if order.count() <= raw.SMALL else order
    bodies = messages(spark, path, chunk).filter(F.substring("body", 1, 1) == F.lit(b"\x12")).join(order, "file").select((F.col("base") + F.col("number")).alias("ord"), "body")

    return bodies.mapInArrow(_decoded, _DOCUMENT)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """occurrences, symbol_info, relationships and documents of the indexes at `path`, as in schema.py."""
    docs = read_documents(spark, path)
    occ = docs.select("doc_ord", "doc", F.explode("occurrences").alias("o")).select("doc_ord", "doc", "o.occ_ord", "o.symbol", "o.symbol_roles", "o.line", "o.enc_start", "o.enc_end")
    sym = docs.select("doc_ord", "doc", F.explode("symbols").alias("s"))
    rel = sym.select("doc_ord", "doc", F.col("s.sym_ord").alias("rel_ord"), F.col("s.symbol").alias("src"), F.explode("s.relationships").alias("r")).select("doc_ord", "doc", "rel_ord", "src", F.col("r.symbol").alias("dst"), "r.is_implementation")
    return {"occurrences": occ, "symbol_info": sym.select("doc_ord", "doc", "s.sym_ord", "s.symbol", "s.display_name"), "relationships": rel, "documents": docs.select("doc_ord", "doc")}


def describe(spark: SparkSession, path: str) -> dict:
    """exists, size, modified, tool, version, root and number of documents of one index; error where it can't be read."""
    try:
        row = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            return {"exists": True, "error": str(e).splitlines()[0]}
        return {"exists": False}
    if row is None:
        return {"exists": False}
    out = {"exists": True, "size": row["length"], "modified": row["modificationTime"].isoformat()}
    try:
        m = messages(spark, path)
        kind = F.substring("body", 1, 1)
        out["documents"] = m.filter(kind == F.lit(b"\x12")).count()
        head = m.filter(kind == F.lit(b"\x0a")).orderBy("number").select("body").first()
        return out | (metadata(body_of(bytes(head["body"]))) if head else {})
    except Exception as e:
        return out | {"error": str(e).splitlines()[0]}


RANGE = 64 << 20  # bytes of documents in a task of the source


def _ranges(f, size: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(offset, end, number of its first message) of runs of messages of about `most` bytes of an open file; only headers are
    read."""
    at = start = number = first = 0
    while at < size:
        f.seek(at)
        head = f.read(2 * _HEADER)
        try:
            n = next(_framed(memoryview(head)))[3]
        except (IndexError, ValueError):
            raise ValueError("a message ends too early") from None
        if at + n > size:
            raise ValueError("a message ends too early")
        if at > start and at + n - start > most:
            yield start, at, first
            start, first = at, number
        at, number = at + n, number + 1
    if at > start:
        yield start, at, first


def _store_of(path: str):
    """(file system, path in it) of a path or address that Arrow knows (local, hdfs, s3, gs and others)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _matching(pattern: str) -> list[str]:
    """The files that a path or pattern names, and those in folders that it names, by their paths."""
    import fnmatch

    from pyarrow import fs

    store, path = _store_of(pattern)
    base = path
    while any(c in base for c in "*?["):
        base = base.rpartition("/")[0]
    one = store.get_file_info(base or "/")
    found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base or "/", recursive=True)) if one.type == fs.FileType.Directory else []
    hit = lambda p: p == path.rstrip("/") or fnmatch.fnmatchcase(p, path)
    files = [x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
    return sorted(p for p in files if any(hit("/".join(p.split("/")[:k])) for k in range(1, p.count("/") + 2)))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("scip").load(path) give occurrences, numbered as by read_index. The source runs without a
    session, so that it reads the stores that Arrow knows; read_index reads all that Spark does."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, path, most):
            self.path, self.most = path, most

        def partitions(self):
            out = []
            store, _ = _store_of(self.path)
            for k, p in enumerate(_matching(self.path)):
                with store.open_input_file(p) as f:
                    out += [InputPartition((p, k << 40, *r)) for r in _ranges(f, f.size(), self.most)]
            return out or [InputPartition(None)]

        def read(self, partition):
            if partition.value is None:
                return
            path, base, start, end, number = partition.value
            store, _ = _store_of(self.path)
            with store.open_input_file(path) as f:
                while start < end:
                    f.seek(start)
                    kind, wire, at, n = next(_framed(memoryview(f.read(2 * _HEADER))))
                    if kind == 2 and wire == 2:
                        f.seek(start + at)
                        d = document(memoryview(f.read(n - at)))
                        for o in d["occurrences"]:
                            yield (base + number, d["doc"], o["occ_ord"], o["symbol"], o["symbol_roles"], o["line"], o["enc_start"], o["enc_end"])
                    start, number = start + n, number + 1

    class Scip(DataSource):
        @classmethod
        def name(cls):
            return "scip"

        def schema(self):
            return schema.OCCURRENCES

        def reader(self, schema):
            return Reader(self.options["path"], int(self.options.get("range", RANGE)))

    spark.dataSource.register(Scip)
