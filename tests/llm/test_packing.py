import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stellate.llm import packing
from stellate.llm.tokens import tokenizer_path


def check(rows, ids, capacity, max_segments):
    """Every id once, sequences without gaps and within limits; returns the padding and the number of ids."""
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        raw = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(raw) // 4
        assert r["ids_crc32"] == zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(covered) == {k for k, v in ids.items() if v}
    for k, v in covered.items():
        at = 0
        for start, n in sorted(v):
            assert start == at and n > 0
            at += n
        assert at == len(ids[k]) // 4
    padding = 0
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity and len(v) <= max_segments
        padding += capacity - at if at & (at - 1) else 0
    return padding


@pytest.mark.parametrize("segments", [256, 3])
def test_documents(spark, docs_of, words, segments):
    data = [(i, words(5 + 13 * (i % 40), i)) for i in range(150)] + [(200, None), (201, ""), (202, words(9000, 5))]
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in data}
    rows = packing.pack_documents(docs_of(data, clash=True), capacity=1024, max_segments=segments).collect()
    padding = check(rows, ids, 1024, segments)
    if segments == 256:
        assert padding == 0


def test_examples_keep_all_limits(spark):
    rng = np.random.default_rng(0)
    data = [(i, list(range(n)), min(50, int(rng.integers(0, n + 1)))) for i, n in enumerate(rng.integers(1, 60, 300).tolist())]
    df = spark.createDataFrame(data, "doc_id long, ids array<int>, loss long").coalesce(1)
    rows = packing.pack_examples(df, "doc_id", "ids", "loss", capacity=128, max_segments=4, max_loss=50).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    held = defaultdict(lambda: [0, 0, 0])
    loss = {i: k for i, _, k in data}
    for r in rows:
        assert r["start"] == 0 and r["token_ids"] == list(range(r["length"]))
        for k, x in enumerate((r["length"], 1, loss[r["doc_id"]])):
            held[r["sequence_id"]][k] += x
    assert all(a <= 128 and b <= 4 and c <= 50 for a, b, c in held.values())
    least = max(sum(len(x) for _, x, _ in data) / 128, 300 / 4, sum(loss.values()) / 50)
    assert len(held) <= 1.25 * least + 2


def test_errors_and_empty(spark, docs_of):
    assert packing.pack_documents(docs_of([])).count() == 0
    assert packing.pack_documents(docs_of([(1, None)]), end_id=None).count() == 0
    with pytest.raises(ValueError):
        packing.Packer(print, capacity=0)
    with pytest.raises(ValueError):
        packing.Packer(print, capacity=4, splittable=False).add(1, 5)
