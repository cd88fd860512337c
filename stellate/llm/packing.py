"""Vector bin packing of token sequences.

Each example is a vector (tokens, segments, loss-bearing tokens); a sequence has a capacity in each dimension. The
packer fills one sequence at a time: of the examples that fit it takes the one with the largest dot product of its
vector and the free capacity, both as fractions of the capacity, so that scarce dimensions weigh more. Examples with
the same vector form one class, so a step costs the number of classes. Where examples may be cut, a gap that no
example fits is filled with the head of the largest one.

Each partition is packed by itself in blocks, without a shuffle; what a block leaves is carried to the next one. What
is left at a partition's end, less than one sequence if examples may be cut and the other limits don't bind, is laid
out in sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes, int_lists
from stellate.llm.tokens import encoder, tokenizer_path

BLOCK_SEQUENCES = 64  # a block is packed when it holds the tokens of so many sequences, or so many times 64 examples


class Packer:
    """Packs examples (key, n, loss) of one partition. `emit` gets (key, start, length, sequence, offset)."""

    def __init__(self, emit: Callable, capacity: int = 4096, max_segments: int = 256, max_loss: int | None = None, splittable: bool = True):
        if min(capacity, max_segments, capacity if max_loss is None else max_loss) < 1:
            raise ValueError("every capacity must be at least 1")
        self.emit, self.splittable = emit, splittable
        self.caps = np.array([capacity, max_segments, max_loss or capacity], np.int64)
        self.pool: dict[tuple[int, int], deque] = defaultdict(deque)
        self.held = self.count = self.sequence = 0

    def add(self, key, n: int, loss: int | None = None, start: int = 0) -> None:
        """loss: how many of the n tokens bear loss; all of them by default. With cuts, loss is spread evenly."""
        loss = n if loss is None else loss
        cap = int(self.caps[0])
        if n > cap or loss > self.caps[2]:
            if not self.splittable:
                raise ValueError(f"an example of {n} tokens, {loss} of them bearing loss, exceeds a sequence")
            size = cap if loss <= self.caps[2] * (n / cap) else max(1, int(self.caps[2] * n // loss))
            while n > size:
                part = -(-loss * size // n)
                if size == cap:
                    self.emit(key, start, size, self.sequence, 0)
                    self.sequence += 1
                else:
                    self._hold(key, start, size, min(part, int(self.caps[2])))
                start, n, loss = start + size, n - size, loss - part
        if n:
            self._hold(key, start, n, max(0, min(loss, n)))

    def _hold(self, key, start: int, n: int, loss: int) -> None:
        self.pool[n, loss].append((key, start))
        self.held += n
        self.count += 1

    @property
    def ready(self) -> bool:
        return self.held >= 2 * BLOCK_SEQUENCES * self.caps[0] or self.count >= 128 * BLOCK_SEQUENCES

    def pack(self, last: bool = False) -> None:
        """Pack down to half a block; with last, everything."""
        floor = 0 if last else BLOCK_SEQUENCES * int(self.caps[0])
        most = 0 if last else 64 * BLOCK_SEQUENCES
        while self.pool and (self.held > floor or self.count > most):
            if last and self.splittable and self.held <= self.caps[0] and self.count <= self.caps[1] and sum(k[1] * len(v) for k, v in self.pool.items()) <= self.caps[2]:
                return self._tail()
            self._fill()

    def _fill(self) -> None:
        classes = np.array(list(self.pool), np.int64)
        vectors = np.stack([classes[:, 0], np.ones(len(classes), np.int64), classes[:, 1]], axis=1)
        scaled, free, offset = vectors / self.caps, self.caps.copy(), 0
        left = np.array([len(self.pool[tuple(c)]) for c in classes.tolist()])
        while True:
            score = np.where((vectors <= free).all(axis=1) & (left > 0), scaled @ (free / self.caps), -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            n, loss = classes[k].tolist()
            self._place(n, loss, n, offset)
            left[k] -= 1
            offset += n
            free -= vectors[k]
        if self.splittable and free[0] and free[1] and left.any():
            live = [(n, loss) for n, loss in self.pool if n > 1]
            for n, loss in sorted(live, reverse=True):
                size = min(int(free[0]), n - 1) if not loss else min(int(free[0]), n - 1, int(free[2] * n // loss))
                if size >= 1:
                    self._place(n, loss, size, offset)
                    break
        self.sequence += 1

    def _place(self, n: int, loss: int, size: int, offset: int) -> None:
        """Put the first `size` tokens of an example of class (n, loss) into the open sequence."""
        key, start = self.pool[n, loss].popleft()
        if not self.pool[n, loss]:
            del self.pool[n, loss]
        self.held -= n
        self.count -= 1
        self.emit(key, start, size, self.sequence, offset)
        if size < n:
            self._hold(key, start + size, n - size, loss - loss * size // n)

    def _tail(self) -> None:
        todo = deque((key, start, n) for (n, _), v in sorted(self.pool.items(), reverse=True) for key, start in v)
        while todo:
            room = 1 << (self.held.bit_length() - 1)
            offset = 0
            while offset < room:
                key, start, n = todo.popleft()
                size = min(n, room - offset)
                self.emit(key, start, size, self.sequence, offset)
                if size < n:
                    todo.appendleft((key, start + size, n - size))
                offset += size
                self.held -= size
            self.sequence += 1
        self.pool.clear()
        self.count = 0


def _numbered(local: int) -> int:
    """Sequence numbers are unique over partitions: the partition in the upper bits."""
    return (TaskContext.get().partitionId() << 40) | local


_PIECES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_ids"]


def _packed(items: Iterable[tuple[object, bytes, int | None]], kind: pa.DataType, ids_too: bool, **limits) -> Iterator[pa.RecordBatch]:
    """items: (id, ids as bytes, tokens that bear loss). Yields batches of pieces."""
    rows: list[tuple] = []
    held: dict[int, list] = {}  # by running number: id, ids, bytes not yet emitted

    def emit(key, start, length, sequence, offset):
        doc = held[key]
        raw = doc[1][4 * start : 4 * (start + length)]
        rows.append((doc[0], start, length, zlib.crc32(raw), len(doc[1]) // 4, _numbered(sequence), offset, raw))
        doc[2] -= length
        if not doc[2]:
            del held[key]

    def batch():
        cols = list(zip(*rows, strict=True))
        rows.clear()
        arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7])]
        if ids_too:
            arrays.append(int_lists(list(cols[7])))
        return pa.RecordBatch.from_arrays(arrays, _PIECES[: len(arrays)])

    packer = Packer(emit, **limits)
    for k, (key, raw, loss) in enumerate(items):
        n = len(raw) // 4
        if not n:
            continue
        held[k] = [key, raw, n]
        packer.add(k, n, loss)
        if packer.ready:
            packer.pack()
        if len(rows) >= 4096:
            yield batch()
    packer.pack(last=True)
    if rows:
        yield batch()


def _schema(kind: str, id_col: str, ids_too: bool) -> str:
    return f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", token_ids array<int>" * ids_too


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int | None = 2, capacity: int = 4096, max_segments: int | None = None, max_loss: int | None = None, ids_too: bool = False, path: str | None = None) -> DataFrame:
    """Encode whole texts, close each with `end_id`, and pack them; texts may be cut. One row for each piece.

    Columns: the id, start and length (its ids in the document), ids_crc32, doc_tokens, sequence_id, offset (in the
    sequence), with `ids_too` also token_ids. A null text is empty; a document without any id (empty, end_id None) has
    no piece. Repeated rows are packed each. Every token bears loss here, and segments are limited only if max_segments
    says so. Long texts are cut over sequences; equally good places go to the first; an empty table gives no rows. Extra
    columns are not read.
    """
    max_segments = capacity if max_segments is None else max_segments
    path = path or tokenizer_path(tokenizer)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        first = next(batches, None)
        if first is None:
            return

        def items():
            for b in by_bytes(chain([first], batches), "text"):
                for key, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                    yield key, raw + tail, None

        yield from _packed(items(), first.column(0).type, ids_too, capacity=capacity, max_segments=max_segments, max_loss=max_loss, splittable=True)

    return bounded_batches(src).mapInArrow(run, _schema(kind, id_col, ids_too))


def pack_examples(examples: DataFrame, id_col: str, ids_col: str, loss_col: str | None = None, capacity: int = 4096, max_segments: int = 64, max_loss: int | None = None, splittable: bool = False) -> DataFrame:
    """Pack examples that are encoded already, such as instructions: ids_col holds array<int>, loss_col how many of
    them bear loss (null: all). Without `splittable` no example is cut and one that exceeds a limit is an error. A null
    or empty list has no piece. Columns as in pack_documents, with token_ids.
    """
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    src = examples.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"), loss.alias("loss"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def items():
            for b in chain([first], batches):
                for key, ids, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    yield key, np.array(ids or [], "<u4").tobytes(), loss

        yield from _packed(items(), first.column(0).type, True, capacity=capacity, max_segments=max_segments, max_loss=max_loss, splittable=splittable)

    return bounded_batches(src).mapInArrow(run, _schema(kind, id_col, True))

