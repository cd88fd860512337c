"""Induced sorting of the strings of one shard, in memory, or on disk where the shard is larger than `memory`.

A shard holds families of strings: spans of text around an anchor. The suffixes at the anchors are sorted by the text
after them, beyond `memory` in runs that lie on disk and are merged by a heap; the common prefix of neighbours comes with them. Then the
order of the suffixes one byte further left is induced from it, again and again: each suffix tuple (preceding byte, rank,
least common prefix since the last tuple of that byte) passes a queue that gives tuples back by byte, then rank. The
common prefix of new neighbours is one more than the least between their old ranks, and 0 at a new byte.

Everything of the size of the shard (its bytes, the order, common prefixes, the queue, the marks) lies in files without a
name once it is larger than `memory`; they are read and written in blocks. A lost executor loses them with its task.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 64 << 20


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both included, for each pair."""
    if not len(lo):
        return np.empty(0, values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out, table, k = np.empty(len(lo), values.dtype), values, 0
    while True:
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        k += 1
        if k > level.max():
            return out
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])


class Shard:
    """Families of strings: `texts` the bytes from the first start on, `left` how far the anchor lies behind the first
    start, `span` last start - first start. Strings are compared up to `length` bytes."""

    def __init__(self, floor: int, length: int, memory: int = MEMORY):
        self.floor, self.length, self.memory = floor, length, memory
        self.block = max(64, memory // 256)
        self.chunks: list[np.ndarray] = []
        self.held, self.file, self.total = 0, None, 0
        self.sizes: list[np.ndarray] = []
        self.lefts: list[np.ndarray] = []
        self.spans: list[np.ndarray] = []
        self.rows = 0

    def add(self, data: np.ndarray, sizes: np.ndarray, left: np.ndarray, span: np.ndarray) -> None:
        """data: the bytes of the families in a row."""
        self.chunks.append(data)
        self.held += len(data)
        self.total += len(data)
        self.sizes.append(sizes.astype(np.int32))
        self.lefts.append(left.astype(np.int32))
        self.spans.append(span.astype(np.int32))
        self.rows += len(sizes)
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            for c in self.chunks:
                self.file.write(c)
            self.chunks, self.held = [], 0

    def _array(self, n: int, kind, columns: int = 0) -> np.ndarray:
        shape = (n, columns) if columns else n
        if n * max(columns, 1) * np.dtype(kind).itemsize <= self.memory:
            return np.zeros(shape, kind)
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)  # noqa: SIM115

    def _finish(self) -> None:
        if self.file is not None:
            for c in self.chunks:
                self.file.write(c)
            self.file.flush()
            self.data = np.memmap(self.file, np.uint8, "r", shape=(self.total,))
        else:
            self.data = np.concatenate(self.chunks or [np.empty(0, np.uint8)])
        self.chunks = []
        join = lambda parts: np.concatenate(parts or [np.empty(0, np.int32)])
        self.size, self.left, self.span = join(self.sizes), join(self.lefts), join(self.spans)
        self.offset = np.cumsum(self.size, dtype=np.int64) - self.size

    def _after(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, sizes) of the bytes after the anchors, zeros behind the end."""
        sizes = np.minimum(self.size[rows] - self.left[rows], self.length)
        at = np.arange(self.length)
        out = np.zeros((len(rows), self.length), np.uint8)
        for i in range(0, len(rows), 1024):
            part, n = rows[i : i + 1024], sizes[i : i + 1024]
            inside = at < n[:, None]
            out[i : i + 1024][inside] = self.data[((self.offset[part] + self.left[part])[:, None] + at)[inside]]
        return out, sizes

    def _run(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        matrix, sizes = self._after(rows)
        order = np.argsort(sizes, kind="stable")
        order = order[np.argsort(np.ascontiguousarray(matrix[order]).view(f"S{self.length}").ravel(), kind="stable")]
        return rows[order], matrix[order]

    def _first_order(self) -> np.ndarray:
        """The families by the bytes after their anchors; ends come before bytes."""
        n, step = self.rows, max(2, self.memory // (4 * self.length))
        if n <= step:
            return self._run(np.arange(n))[0].astype(np.int32)
        runs = []
        for a in range(0, n, step):
            rows, matrix = self._run(np.arange(a, min(n, a + step)))
            kept = self._array(len(rows), np.uint8, self.length)
            kept[:] = matrix
            runs.append((rows, kept))
        out, block, at = self._array(n, np.int32), [], 0

        def entries(rows, matrix):
            for k, r in enumerate(rows.tolist()):
                yield matrix[k].tobytes(), min(int(self.size[r] - self.left[r]), self.length), r

        for _, _, r in heapq.merge(*(entries(*x) for x in runs)):
            block.append(r)
            if len(block) == self.block:
                out[at : at + len(block)] = block
                at, block = at + len(block), []
        out[at:] = block
        return out

    def _first_common(self, order: np.ndarray) -> np.ndarray:
        common = self._array(len(order), np.int16)
        step = max(2, self.memory // (8 * self.length))
        for a in range(1, len(order), step):
            matrix, sizes = self._after(order[a - 1 : a + step])
            differ = matrix[1:] != matrix[:-1]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), self.length)
            common[a : a + step] = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
        return common

    def _induce(self, o: int, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and common prefixes of the suffixes that begin `o` before the anchors."""
        n, step = len(order), self.block
        count, byte = np.zeros(256, np.int64), self._array(n, np.int16)
        for a in range(0, n, step):
            rows = order[a : a + step]
            live = self.left[rows] >= o
            got = np.full(len(rows), -1, np.int16)
            got[live] = self.data[(self.offset[rows] + self.left[rows] - o)[live]]
            byte[a : a + step] = got
            count += np.bincount(got[live], minlength=256)
        out, low = self._array(int(count.sum()), np.int32), self._array(int(count.sum()), np.int16)
        begin = np.cumsum(count) - count
        place, most = begin.copy(), np.iinfo(np.int16).max
        since = np.full(256, most, np.int16)  # the least common prefix after the last tuple of each byte
        for a in range(0, n, step):
            here, got, rows = np.asarray(common[a : a + step]), byte[a : a + step], order[a : a + step]
            live = np.flatnonzero(got >= 0)
            queue = live[np.argsort(got[live], kind="stable")]
            b = got[queue]
            if not len(queue):
                since = np.minimum(since, here.min())
                continue
            new = np.concatenate([[True], b[1:] != b[:-1]])
            least = np.empty(len(queue), np.int16)
            least[new] = np.minimum(since[b[new]], np.minimum.accumulate(here)[queue[new]])
            again = np.flatnonzero(~new)
            least[again] = range_min(here, queue[again - 1] + 1, queue[again])
            least = np.minimum(least, self.length - 1) + 1
            at = np.flatnonzero(new)
            least[at[place[b[at]] == begin[b[at]]]] = 0
            to = place[b] + np.arange(len(b)) - np.repeat(at, np.diff([*at, len(b)]))
            out[to], low[to] = rows[queue], least
            place += np.bincount(b, minlength=256)
            last = queue[np.concatenate([at[1:], [len(b)]]) - 1]
            tail = np.append(np.minimum.accumulate(here[::-1])[::-1], np.int16(most))
            since = np.minimum(since, here.min())
            since[b[at]] = tail[last + 1]
        return out, low

    def classes(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first family, matrix (family, start)) by blocks of families: 1 where the string of `floor` bytes from that
        start begins elsewhere in the shard too, 2 where that of `length` bytes does, else 0."""
        self._finish()
        if not self.rows:
            return
        wide = int(self.span.max()) + 1
        found = self._array(self.rows, np.uint8, wide)
        order = self._first_order()
        common = self._first_common(order)
        for o in range(int(self.left.max()) + 1):
            if o:
                order, common = self._induce(o, order, common)
            for a in range(0, len(order), self.block):
                mine = np.asarray(common[a : a + self.block])
                next_ = common[a + 1 : a + self.block + 1]
                best = mine.copy()
                best[: len(next_)] = np.maximum(mine[: len(next_)], next_)
                rows = order[a : a + self.block]
                start = self.left[rows] - o
                hit = np.flatnonzero((best >= self.floor) & (start <= self.span[rows]))
                found[rows[hit], start[hit]] = 1 + (best[hit] >= self.length)
        step = max(1, self.block // wide)
        for a in range(0, self.rows, step):
            yield a, np.asarray(found[a : a + step])
