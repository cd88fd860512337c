import random
import re

import numpy as np
import pytest
import xxhash

from stellate.llm import golay, simhash
from stellate.llm.components import components


def test_code_is_perfect():
    code = golay.codewords()
    assert len(set(code.tolist())) == 4096
    assert np.bitwise_count(code[1:] ^ code[0]).min() == 7
    assert (golay.decoder() >= 0).all()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    held = [set() for _ in x]
    for r, k in zip(*(a.tolist() for a in golay.keys(x)), strict=True):
        assert k not in held[r]
        held[r].add(k)
    hit = np.zeros(len(x), bool)
    for r, k in zip(*(a.tolist() for a in golay.keys(y)), strict=True):
        hit[r] |= k in held[r]
    assert hit.all()


def slow_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_wide(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hs = [int.from_bytes(xxhash.xxh3_128_digest(s.encode(), 42), "little") for s in sh]
    f = sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return [f & (1 << 64) - 1, f >> 64]


def test_wide_keys_meet_within_six_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(6):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    sets = []
    for v in (x, y):
        held = [set() for _ in v]
        for r, k in zip(*(a.tolist() for a in golay.wide_keys(v)), strict=True):
            held[r].add(k)
        sets.append(held)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_wide_links_of_changed_texts(spark, docs_of, words):
    """Texts with some words changed are found, also where buckets are dealt in blocks; unrelated ones are left alone."""
    rng = random.Random(8)
    data = []
    for i in range(40):
        w = words(200 + i, i).split()
        data.append((10 * i, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for p in rng.sample(range(len(v)), k):
                v[p] = "changed"
            data.append((10 * i + k, " ".join(v)))
    for limit in (simhash.MAX_BUCKET, 2):
        got = simhash.near_duplicates(docs_of(data), shingle=5, mode=simhash.WIDE, max_bucket=limit).collect()
        assert all(r["component_id"] // 10 == r["id"] // 10 for r in got)
        assert sum(r["component_id"] == r["id"] // 10 * 10 for r in got) > 0.97 * len(got)


def test_wide_recall_of_similar_texts(words):
    """Of isolated pairs that by brute force share 0.8 to 0.85 of their shingles, nearly all are candidates."""
    rng, found = random.Random(6), []
    for i in range(200):
        w = words(200, 4000 + i).split()
        v = list(w)
        for p in rng.sample(range(10, 190, 10), 4):
            v[p] = "changed"
        a, b = ({" ".join(x[k : k + 5]) for k in range(196)} for x in (w, v))
        assert 0.8 <= len(a & b) / len(a | b) < 0.85
        x, y = (simhash.fingerprint(" ".join(t).encode(), 5, simhash.WIDE) for t in (w, v))
        both = (golay.mixtures(t[:1], t[1:]) for t in (x, y))
        share = any(set(golay.wide_keys(a)[1].tolist()) & set(golay.wide_keys(b)[1].tolist()) for a, b in zip(*both, strict=True))
        found.append(share and bool(simhash._near(x, y, simhash.WIDE)))
    assert np.mean(found) > 0.98, np.mean(found)


def test_fingerprints(monkeypatch, words):
    for block in (1 << 16, 7):
        monkeypatch.setattr(simhash, "SHINGLE_BLOCK", block)
        for t in ["", " \n", "One", "one TWO", "Ünïcode É\xa0x y", words(100, 1), "a b c a b c a b c"]:
            for n in (3, 5):
                assert simhash.fingerprint(t.encode(), n).tolist() == [slow_fingerprint(t, n)]
                assert simhash.fingerprint(t.encode(), n, simhash.WIDE).tolist() == slow_wide(t, n)


def groups(fps):
    """Component roots (least index) of fingerprints under links of three bits."""
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


@pytest.mark.parametrize("limit", [32768, 3])
def test_links_of_dense_groups(spark, limit):
    """Chains and clouds of near fingerprints, also where every bucket is over its limit and dealt in blocks."""
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps = sorted(set(fps), key=lambda f: f - (1 << 64) if f >> 63 else f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash.links(spark.createDataFrame([(f, 0) for f in signed], "fp long, fp2 long"), max_bucket=limit))
    name = lambda f: f.to_bytes(8, "big") + bytes(8)
    got = {bytes(r["node"]): bytes(r["component"]) for r in found.collect()}
    of = {}
    for f, r in zip(fps, groups(fps), strict=True):
        of.setdefault(r, []).append(name(f))
    assert got == {k: min(v) for v in of.values() if len(v) > 1 for k in v}


def test_near_duplicates(spark, docs_of, words):
    data = [(i, words(60 + i % 50, i)) for i in range(40)]
    data += [(100 + i, data[3][1]) for i in range(30)] + [(200 + i, data[5][1].replace(" ", "  ").upper()) for i in range(3)]
    data += [(300, None), (301, ""), (302, "\n"), (7, data[3][1]), (8, data[8][1]), (None, data[9][1])]
    df = docs_of(data, clash=True)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(data)
    keyed = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [slow_fingerprint(t) for _, t in keyed]
    want = sorted(((i, keyed[r][0]) for (i, _), r in zip(keyed, groups(fps), strict=True)), key=str)
    assert sorted(((r["id"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.dtypes == df.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({keyed[r][0] for r in groups(fps)})
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [simhash.MAX_GROUP, 3])
def test_links_are_verified(spark, docs_of, words, monkeypatch, limit):
    """Only pairs that share 0.8 of their shingles are linked, also where a group is dealt in blocks."""
    rng, data = random.Random(9), []
    for i in range(15):
        w = words(150 + i, i).split()
        for k in (0, 0, 1, 2, 4, 5, 6, 7):
            v = list(w)
            for p in rng.sample(range(len(v)), k):
                v[p] = "changed"
            data.append((len(data), " ".join(v)))
    data += [(900, None), (901, ""), (902, "one two"), (903, "One  two")]
    sets = []
    for _, t in data:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    similar = [{j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)} for a in sets]
    monkeypatch.setattr(simhash.verified, "__defaults__", (limit,))
    mode = {"shingle": 5, "mode": simhash.WIDE}
    near = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(data), **mode).collect()}
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(data), **mode, similarity=simhash.SIMILARITY).collect()}
    split = 0
    for i, (a, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            new = {j for j in similar[todo.pop()] - seen if near[data[j][0]] == near[a]}
            seen |= new
            todo += new
        assert {j for j, (b, _) in enumerate(data) if got[b] == got[a]} == seen
        split += len({got[b] for b, _ in data if near[b] == near[a]}) > 1
    assert split and got[900] == got[901] and got[902] == got[903]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(71)} | {200: 200, 201: 200}
