import math

import numpy as np
import pytest

from stellate.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, v string, x int, score string"


def brute(rows, every=100):
    """(anchor, positive, rank, negative, scores), from all pairs of rows in unlimited integers."""
    use = [(i, r[0], r[2], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, vid, label, q in use:
        if vid is None or vid % every:
            continue
        score = [(-sum(a * b for a, b in zip(q, v)), math.inf if o is None else o, j, lab) for j, o, lab, v in use if j != i]
        for p in sorted(s for s in score if s[3] == label)[:5]:
            good = sorted(s for s in score if s[3] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0])[:5]
            out += [(vid, None if p[1] == math.inf else p[1], k + 1, None if s[1] == math.inf else s[1], -p[0], -s[0]) for k, s in enumerate(good)]
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", "b", 3, "c") for r in rows], SCHEMA)
    got = [tuple(r) for r in negatives.hard_negatives(df, **how).collect()]
    long = lambda r: tuple(None if x is None else max(-(2**63), min(2**63 - 1, x)) for x in r)
    assert sorted(map(repr, got)) == sorted(repr(long(r)) for r in brute(rows, how.get("anchor_every", 100)))
    return got


@pytest.mark.parametrize("group,tile,rows_", [(1024, 256, 4096), (7, 3, 16)])
def test_against_all_pairs(spark, monkeypatch, group, tile, rows_):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "ROWS", rows_)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 9)).astype(np.float32)
    v[100:180] = v[0]  # many equal vectors, of several labels
    rows = [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += rows[:30]  # repeated rows
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [float("nan"), 1.0], 1), (800, [float("inf")], 2), (900, [1.0, 2.0], None), (None, [0.5] * 9, 1), (None, [0.5] * 9, 2), (1000, [], 1), (1100, [3.0, 1.0], 1), (1200, [-0.001] * 20, 3)]
    assert len(check(spark, rows, anchor_every=10, group=group)) > 400


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 30)).tolist(), int(rng.integers(0, 2))) for i in range(60)]
    rows += [(100 + i, [3e38, -3e38], i % 2) for i in range(4)]
    assert check(spark, rows, anchor_every=5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(df).count() == 0
    check(spark, [(100, [1.0], 1)])
    check(spark, [(1, [1.0], 1), (2, [1.0], 2)])


def test_bounds_hold(spark):
    """No exact score lies outside its bounds, and on spread-out vectors they leave few rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    v = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    book = negatives.centroids(v[:2000].astype(float))
    codes, rest = negatives.encode(v, book)
    q = v[::100]
    lo, hi = negatives.Tables(q, book).bounds(codes, rest, slice(None))
    score = v @ q.T
    assert (lo <= score).all() and (score <= hi).all()
    fifth = -np.sort(-score, axis=0)[5]
    assert (hi >= fifth).mean() < 0.2


def test_sql_agrees(spark):
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["op12_hard_negatives"]).fetchall()
    got = __spark_entry__.queries()["op12_hard_negatives"](spark, d).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
