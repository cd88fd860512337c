import zlib
from hashlib import sha256

import pytest

from stellate.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, node string, block string, path string, id string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """Each row's digests, from whole trees."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        langs[x].sort(key=lambda t: t[:3])
        trees[x] = tree_of([t[2] for t in langs[x]])
    over = tree_of([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(langs[x]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf_of(*r[:4], r[4] + 1) if hit else leaf
            siblings = []
            for tree, at in ((trees[x], i), (over, k)):
                for level in tree[:-1]:
                    pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [v for j, v in enumerate(pair) if j != at % 2]
                    pair[at % 2] = h
                    h, at = H(*pair), at // 2
            root = over[-1][0]
            out.append((r[0], leaf, trees[x][-1][0], root, H(*siblings), h, h == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z", "w") for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.manifest(df, merkle.one_more(df), **how).select(*COLUMNS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    return got


@pytest.mark.parametrize("how", [{}, {"block": 2}, {"block": 2, "top": 3}, {"block": 1, "top": 1}])
def test_against_whole_trees(spark, how):
    """Blocks, further reductions and more languages than the driver takes give the same proofs."""
    rows = [(i, f"text {i}" * (i % 5), ("en", "de", None, "é")[min(i % 7, 3)], f"s{i % 3}", i) for i in range(61)]
    rows += [(7, "text", "en", "s", 3), (7, "text", "en", "s", 3), (7, None, "en", None, None), (None, "", "fr", "s", 2**63 - 1)]
    rows += [(100 + i, "x", f"l{i}", "s", i) for i in range(9)]
    got = check(spark, rows, **how)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_small_tables(spark):
    check(spark, [(1, "only", "en", "s", 4)])
    check(spark, [(1, None, None, None, None), (2, "", "", "", 0)])
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0


def test_long_text_and_repeated_rows(spark):
    check(spark, [(1, "é" * 2_000_000, "en", "s", 1)] + [(2, "copy", "en", "s", 4)] * 40, block=3)


def test_sql_agrees(spark):
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["op11_merkle_manifest"]).fetchall()
    got = __spark_entry__.queries()["op11_merkle_manifest"](spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(want)
