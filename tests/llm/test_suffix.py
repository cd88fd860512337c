import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stellate.llm import induced, suffix


def brute(texts, length):
    seen, covered = {}, [np.zeros(len(t), bool) for t in texts]
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((d, s))
    for v in seen.values():
        if len(v) > 1:
            for d, s in v:
                covered[d][s : s + length] = True
    return covered


def hard_texts(n=150, seed=3):
    rng = random.Random(seed)
    text = lambda k, a: "".join(rng.choice(a) for _ in range(k))
    base = [text(300, "abcdé") for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rng.choice([text(rng.randint(0, 40), "ab"), rng.choice(base)[rng.randint(0, 150) : rng.randint(100, 300)], "xy" * rng.randint(0, 60), "\0" * rng.randint(0, 50)]) for _ in range(rng.randint(0, 8))]
        out.append((i, "".join(parts) or None))
    return [*out, (n, out[1][1]), (2, out[2][1]), (2, "another text of one id")]


@pytest.mark.parametrize("limits", [{"window": 24}, {"window": 24, "shard_rows": 10, "memory": 4096}, {"window": 24, "hot": 3}, {"window": 9}, {"window": 11, "floor": 25}, {"window": 17, "floor": 25, "hot": 2, "memory": 4096}])
def test_against_all_strings(spark, docs_of, limits):
    rows = hard_texts()
    df = docs_of(rows, clash=True)
    got = suffix.remove_repeats(df, length=40, digest=True, **limits).collect()
    want, texts = [], [(t or "").encode() for _, t in rows]
    for (i, t), c, f in zip(rows, brute(texts, 40), brute(texts, limits.get("floor", 40)), strict=True):
        raw = (t or "").encode()
        kept = bytes(np.frombuffer(raw, np.uint8)[~c]) if raw else b""
        want.append((i, len(raw), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), int(f.sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_whole_length_and_texts(spark, docs_of, words):
    passage = words(90, 1)
    assert len(passage) > 450
    data = [(1, words(50, 2) + passage + words(40, 3)), (2, passage + words(60, 4)), (3, words(200, 5)), (4, passage), (5, None), (6, words(40_000, 6))]
    df = docs_of(data, clash=True)
    got = {r["doc_id"]: r for r in suffix.cut_repeats(df).collect()}
    assert got[1]["text"] == data[0][1].replace(passage, "") and got[1]["n_chars"] == len(got[1]["text"])
    assert set(got) == {1, 2, 3, 5, 6} and got[5]["text"] is None
    assert got[3]["text"] == data[2][1] and got[6]["text"] == data[5][1]
    assert suffix.cut_repeats(df).dtypes == df.dtypes
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_read_in_blocks(monkeypatch, words):
    text = words(3000, 9).encode()
    buf, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = suffix.families(buf, offsets)
    monkeypatch.setattr(suffix, "BLOCK", 1000)
    for a, b in zip(whole, suffix.families(buf, offsets), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("memory", [1 << 26, 4096])
def test_induced_order(memory):
    """With 4,096 bytes of memory for a shard of 60,000 bytes everything lies in files and runs are merged."""
    rng = random.Random(1)
    n, floor, length = 1000, 8, 12
    texts = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(floor + 10, 60))) for _ in range(n)]
    left = np.array([rng.randint(10, 14) for _ in texts])
    span = np.array([rng.randint(0, min(10, len(t) - floor)) for t in texts])
    shard = induced.Shard(floor, length, memory)
    for i in range(0, n, 100):
        k = slice(i, i + 100)
        shard.add(np.frombuffer(b"".join(texts[k]), np.uint8), np.array([len(t) for t in texts[k]]), left[k], span[k])
    got = [row for _, block in shard.classes() for row in block]
    assert (shard.file is not None) == (memory == 4096)
    for o in range(15):
        at = [(i, int(left[i]) - o) for i in range(n)]
        here = [(i, s) for i, s in at if 0 <= s]
        count = {m: Counter(texts[i][s : s + m] for i, s in here) for m in (floor, length)}
        for i, s in here:
            if s <= span[i]:
                again = lambda m: s + m <= len(texts[i]) and count[m][texts[i][s : s + m]] > 1  # noqa: B023, E731
                assert got[i][s] == again(floor) + again(length)


def test_order_of_runs():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(5, 30))) for _ in range(500)]
    orders = []
    for memory in (1 << 26, 2048):
        shard = induced.Shard(5, 20, memory)
        shard.add(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.zeros(500), np.zeros(500))
        shard._finish()
        orders.append([texts[i][:20] for i in shard._first_order()])
    assert orders[0] == orders[1] == sorted(t[:20] for t in texts)
