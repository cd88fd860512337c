"""Benchmark decontamination with spaced seeds.

Texts become words (Unicode lower case, runs of letters and digits). A seed is a fixed mask of word positions; the
positions between them are ignored, so a changed word there does no harm. The three masks of five words meet every run of
8 or 9 words with one changed word, of 10 to 14 with two and of 15 with three. Items of fewer than 8 words have masks of
their length: all words for up to 4, and all but one inner word for 5 to 7, which is every way to keep 80 % of them.
Seed hashes of the benchmark are looked up at every word of every text; each hit gives an alignment of a text and an item,
whose words are compared one by one: an overlap is a longest stretch of aligned words of which 80 % or more are equal, that
begins and ends with equal words, and it counts if it has 13 words or the whole item. Items without a word match nothing.

The benchmark is the query set. It is dealt into blocks of a bounded size; one block at a time comes to the driver and is
broadcast, and with several each pass over the texts is written before the next block is read, so that no more than one is
held anywhere. More blocks mean more passes over the texts. (A join of all seeds of the texts would shuffle three hashes for each word of the
corpus, many times the corpus, to find what a lookup in some megabytes finds.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes, remove_path, written

#: Word positions of the masks.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
SHORT, MIN_OVERLAP = 8, 13
SAME_OF_FIVE = 4  # four words of five, 80 %
BLOCK_WORDS = 500_000
HITS = 1 << 20
_TABLE_BITS = 22
_SEPARATORS = r"[^\p{L}\p{N}]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's begin (with the end)."""
    from xxhash import xxh3_64_intdigest

    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _SEPARATORS)
    coded = lists.values.dictionary_encode()
    hashes = np.array([xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    index = coded.indices.to_numpy()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    all_ = hashes[index] if len(hashes) else np.empty(0, np.uint64)
    real = all_ != 0
    before = np.concatenate([[0], np.cumsum(real)])
    return all_[real], before[offsets]


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of n words."""
    whole = tuple(range(n))
    if n >= SHORT:
        return MASKS
    return tuple(whole[:k] + whole[k + 1 :] for k in range(1, n - 1)) if n >= 5 else (whole,)


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, sum(1 << k for k in mask), np.uint64)
    for k in mask:
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ words[k : k + n]
        out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class SeedIndex:
    """The seeds of a block of items: sorted hashes with item and place, and a table of their leading bits."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.masks = sorted({m for n in {len(w) for w in words} for m in masks_of(n)})
        hashes, items, places = [], [], []
        for i, w in enumerate(words):
            for mask in masks_of(len(w)):
                h = _seeds(w, mask)
                hashes.append(h)
                items.append(np.full(len(h), i, np.int64))
                places.append(np.arange(len(h), dtype=np.int64))
        h = np.concatenate(hashes or [np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.items, self.places = (np.concatenate(x or [np.empty(0, np.int64)])[order] for x in (items, places))
        self.longest = max((len(w) for w in words), default=0)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def alignments(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place of the item's first word in the row of words) of all hits inside one text, once each, in
        this order. Hits are laid out HITS at a time, and each part is reduced to its different alignments."""
        found, wide = [np.empty(0, np.int64)], len(words) + self.longest + 1
        for mask in self.masks:
            h = _seeds(words, mask)
            at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            text = np.searchsorted(ends, at, "right") - 1
            inside = at + mask[-1] < ends[text + 1]
            at, lo, n, text = at[inside], lo[inside], n[inside], text[inside]
            total = np.cumsum(n)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + HITS, "right")))
                k = n[i:j]
                pick = np.repeat(lo[i:j], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                first = np.repeat(at[i:j], k) - self.places[pick] + self.longest
                found.append(np.unique((np.repeat(text[i:j], k) * len(self.words) + self.items[pick]) * wide + first))
                i = j
        key = np.unique(np.concatenate(found))
        return key // wide // len(self.words), key // wide % len(self.words), key % wide - self.longest

    def overlaps(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, words, equal words) of the longest overlap of each text and item."""
        if not self.words:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, at in zip(*(x.tolist() for x in self.alignments(words, ends)), strict=True):
            want, lo, hi = self.words[item], int(ends[text]), int(ends[text + 1])
            i, j = max(0, lo - at), min(len(want), hi - at)
            least = min(len(want), MIN_OVERLAP)
            if j - i < max(least, best.get((text, item), (0,))[0]):
                continue
            same = want[i:j] == words[at + i : at + j]
            if 5 * np.count_nonzero(same) < SAME_OF_FIVE * least:
                continue
            start, n, equal = longest(same)
            if n >= least and (n, equal) > best.get((text, item), (0, 0, 0))[:2]:
                best[text, item] = (n, equal, at + i + start - lo)
        return [(text, item, start, n, same) for (text, item), (n, same, start) in best.items()]


def longest(same: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal) of the longest stretch, first of its length, that begins and ends with equal words and has
    80 % or more of them."""
    if not same.any():
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 5 - SAME_OF_FIVE, -SAME_OF_FIVE))])
    low = np.minimum.accumulate(np.where(same, total[:-1], len(same) + 1))  # over starts at equal words
    first = np.searchsorted(-low, -total[1:], "left")
    length = np.where(same, np.arange(1, len(total)) - first, 0)
    k = int(length.argmax())
    i = int(first[k])
    return i, k + 1 - i, int(same[i : k + 1].sum())


WORD_BYTES = 6  # of a benchmark's text for each of BLOCK_WORDS


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """(id, text) of the benchmark in blocks of about block_words words, by a hash of the items."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (WORD_BYTES * block_words))
    return [items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def _index(block: DataFrame) -> tuple[list, SeedIndex]:
    """The ids and the index of one block's items."""
    ids, words = [], []
    for r in block.collect():
        w, _ = words_of(pa.array([r["text"]], pa.string()))
        if len(w):
            ids.append(r["id"])
            words.append(w)
    return ids, SeedIndex(words)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each text and item that overlap: the id, the item's id, start (first word of the overlap in the text),
    n_words, n_equal, contaminated (true). Null and empty texts overlap nothing; repeated rows are reported each;
    without an item, or without a document, there are no rows. Of equally long overlaps of a text and an item the one with
    more equal words is given, then the first. Texts of any length are read whole. Extra columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = src.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, start long, n_words long, n_equal long"
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    paths = []
    out = src.limit(0).select("id", F.lit(None).cast(item_kind).alias("item"), *(F.lit(0).cast("long").alias(c) for c in ("start", "n_words", "n_equal")))
    for block in blocks:
        sent = spark.sparkContext.broadcast(_index(block))

        def run(batches, sent=sent):
            ids, index = sent.value
            for b in by_bytes(batches, "text"):
                rows = index.overlaps(*words_of(b.column(1)))
                if rows:
                    text, item, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array([ids[i] for i in item]), *(pa.array(x, pa.int64()) for x in rest)], ["id", "item", "start", "n_words", "n_equal"])

        out = bounded_batches(src).mapInArrow(run, schema)
        if len(blocks) > 1:
            paths.append(written(out, "overlaps")[1])
            sent.destroy()
    if paths:
        out = spark.read.parquet(*paths)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), "start", "n_words", "n_equal", F.lit(True).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` whose text overlaps no item, as they are, whatever their columns are called. Null and empty texts
    stay, repeated rows share their fate."""
    spark, out, schema = docs.sparkSession, docs, docs.schema
    place = docs.columns.index(text_col)
    numbered = benchmark.select(F.col(item_text_col).alias("text"), F.lit(0).alias("item"))
    blocks, path = _blocks(numbered, "item", "text", block_words), None
    for block in blocks:
        sent = spark.sparkContext.broadcast(_index(block)[1])

        def run(batches, sent=sent):
            for b in by_bytes(batches, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in sent.value.overlaps(*words_of(b.column(place)))]] = False
                yield b if keep.all() else b.filter(pa.array(keep))

        out = bounded_batches(out).mapInArrow(run, schema)
        if len(blocks) > 1:
            before = path
            out, path = written(out, "clean")
            sent.destroy()
            if before:
                remove_path(spark, before)
    return out
