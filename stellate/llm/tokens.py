"""Token ids by units: texts are cut at boundaries that no token crosses, and each distinct unit is encoded once.

A space between two characters that are not white space is a safe boundary for both kinds of vocabulary here: the
byte-level pattern starts a new piece at such a space, the word pattern drops it, and normalisation does not reach
across it. What stands between two such spaces is a unit. Arrow cuts a batch into units and numbers the distinct ones;
the library encodes those that the worker doesn't know, many at a time, joined by spaces, and the ids are told apart
by the marks that the vocabulary puts at word starts or ends (where the marks don't add up, one by one); the ids of the
texts are then gathered from those of the units. A worker keeps the ids of short units in a table of bounded size, the
older half of which is dropped when it is full.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_UNITS = 1_000_000
CACHED_CHARS = 48
JOINED_UNITS = 500

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: A space that is not safe, or white space besides the space and the newline.
_UNSAFE = r"[ \n] | \n|\A[ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _words(unit: str) -> int:
    """How many words and marks the word pattern finds at least in a plain unit; 0 where that is not plain to see."""
    n = 0
    for part in unit.split("\n"):
        if part.isalpha():
            n += 1
        elif part[-1:] in (".", ",") and part[:-1].isalpha():
            n += 2
        else:
            return 0
    return n


class UnitEncoder:
    """Encodes texts with one vocabulary file of the tokenizers library, without added special tokens.

    counts=True keeps the number of ids of each unit only.
    """

    def __init__(self, path: str, counts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.counts = Tokenizer.from_file(path), counts
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab = model.get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.by_ends = bool(suffix)
        self.mark = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.mark[[i for t, i in vocab.items() if (t.endswith(suffix) if suffix else t.startswith("\u0120"))]] = True
        self.known = pa.array([], pa.string())  # cached units, their numbers of ids, and these in a row
        self.sizes = np.empty(0, np.int64)
        self.flat = np.empty(0, "<u4")

    def _singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids in a row) of texts by themselves."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, self.flat[:0] if self.counts else np.array([i for e in found for i in e.ids], "<u4")

    def _joined(self, todo: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(units, numbers of ids, ids in a row) of units that follow a space, perhaps in another order."""
        words = np.array(list(map(_words, todo)) if self.by_ends else [" " not in u for u in todo], np.int64)
        plain = todo if words.all() else [todo[i] for i in np.flatnonzero(words)]
        rest, words = [todo[i] for i in np.flatnonzero(words == 0)], words[words > 0]
        parts = [plain[i : i + JOINED_UNITS] for i in range(0, len(plain), JOINED_UNITS)]
        found = self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        done, sizes, flat = [], [], []
        for k, (part, e) in enumerate(zip(parts, found, strict=True)):
            ids = np.array(e.ids, "<u4")
            marks = np.flatnonzero(self.mark[ids])
            upto = np.cumsum(words[k * JOINED_UNITS : k * JOINED_UNITS + len(part)])
            if len(marks) != upto[-1] or not self.by_ends and marks[0]:
                rest += part
                continue
            done += part
            sizes.append(np.diff(np.concatenate([[0], marks[upto - 1] + 1] if self.by_ends else [marks, [len(ids)]])))
            flat.append(ids)
        if rest:
            more, ids = self._singly([" " + u for u in rest])
            done += rest
            sizes.append(more)
            flat.append(ids)
        return done, np.concatenate(sizes), self.flat[:0] if self.counts else np.concatenate(flat)

    def _values(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of ids, where they begin, ids) of distinct units that follow a space."""
        at = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy().astype(np.int64)
        sizes, flat = self.sizes, self.flat
        if (at < 0).any():
            done, new, ids = self._joined(units.filter(pa.array(at < 0)).to_pylist())
            added = pa.array(done, pa.string())
            fresh = pc.index_in(units, value_set=added) if len(done) else None
            at = np.where(at < 0, pc.fill_null(fresh, 0).to_numpy() + len(sizes), at)
            sizes, flat = np.concatenate([sizes, new]), np.concatenate([flat, ids])
            self._keep(added, new, ids)
        starts = np.cumsum(sizes) - sizes
        return sizes[at], starts[at], flat

    def _keep(self, units: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Add short units to the table; drop its older half when it is full."""
        short = pc.less_equal(pc.utf8_length(units), CACHED_CHARS)
        if not pc.all(short, min_count=0).as_py():
            mask = short.to_numpy(zero_copy_only=False)
            units, ids = units.filter(short), ids if self.counts else ids[np.repeat(mask, sizes)]
            sizes = sizes[mask]
        drop = len(self.known) // 2 if len(self.known) + len(units) > CACHED_UNITS else 0
        gone = 0 if self.counts else int(self.sizes[:drop].sum())
        self.known = pa.concat_arrays([self.known[drop:], units])
        self.sizes = np.concatenate([self.sizes[drop:], sizes])
        self.flat = np.concatenate([self.flat[gone:], ids])

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units of the texts, in order, and where each text's begin (with the end)."""
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        if not pc.any(unsafe).as_py():
            lists = pc.split_pattern(texts, " ")
            return lists.values, lists.offsets.to_numpy()
        parts = [_SAFE.split(t) if bad else t.split(" ") for t, bad in zip(texts.to_pylist(), unsafe.to_pylist(), strict=True)]
        return pa.array([u for p in parts for u in p], pa.string()), np.cumsum([0, *map(len, parts)])

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts in a row and where each text's begin (with the end); without ids if only counts are kept.
        A null is an empty text."""
        gc.disable()  # many small objects, none in cycles
        try:
            return self._arrays(texts)
        finally:
            gc.enable()

    def _arrays(self, texts: pa.Array) -> tuple[np.ndarray | None, np.ndarray]:
        texts = pa.array(pc.fill_null(texts, "").to_pylist(), pa.string()) if texts.offset else pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        units, at = self._units(texts)
        coded = units.dictionary_encode()
        index = coded.indices.to_numpy().copy()
        sizes, starts, flat = self._values(coded.dictionary)
        first, ids = self._singly(units.take(pa.array(at[:-1])).to_pylist())
        index[at[:-1]] = np.arange(len(sizes), len(sizes) + len(first))  # a text's first unit follows no space
        starts = np.concatenate([starts, len(flat) + np.cumsum(first) - first])
        sizes, flat = np.concatenate([sizes, first]), np.concatenate([flat, ids])
        lengths = sizes.astype(np.int32)[index]
        ends = np.cumsum(lengths, dtype=np.int64)
        upto = np.concatenate([[0], ends[at[1:] - 1]])
        if self.counts:
            return None, upto
        kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
        pick = np.repeat((starts[index] - (ends - lengths)).astype(kind), lengths)
        pick += np.arange(len(pick), dtype=kind)
        return flat[pick], upto

    def encode(self, texts: pa.Array | list[str]) -> list:
        """For each text its ids as little-endian unsigned 32-bit integers, or their number."""
        ids, at = self.arrays(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if self.counts:
            return np.diff(at).tolist()
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]


_ENCODERS: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, counts: bool = False) -> UnitEncoder:
    """One encoder for each worker process and vocabulary."""
    if (path, counts) not in _ENCODERS:
        _ENCODERS[path, counts] = UnitEncoder(path, counts)
    return _ENCODERS[path, counts]
