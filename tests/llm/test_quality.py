import glob
import os
import random
import re

import duckdb
import pandas as pd
import pytest

from stellate.llm import quality, queries, sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def test_base_counts(spark, docs_of, words):
    rng = random.Random(3)
    pieces = ["a", "b", "#", "é*", " ", "\t", "\n", "\r\n", "\x0b", "<x>", "\xa0", "🙂", "a b a b", " x", "\n\n"]
    data = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    data += [(200, None), (201, ""), (202, words(5000, 1)), (203, words(70_000, 2)), (204, "ha " * 5000), (7, "other text"), (8, data[8][1])]
    got = quality.quality_rules(docs_of(data, clash=True)).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r["doc_id"], *(r[c] for c in columns)) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in data), key=str)


def test_lines_copies_and_depletion(spark, docs_of, words):
    notice = "Subscribe to  our LETTER today and never miss a single story again " * 4
    body = lambda s: "\n".join(words(12, 100 * s + k) for k in range(6))
    data = [(i, f"{body(i)}\n{notice}{i % 2 * ' '}") for i in range(40)]  # a notice among different texts
    data += [(100 + i, f"{words(10, 9000 + i)}\n{notice}") for i in range(10)]  # little else than the notice
    data += [(200 + i, body(999)) for i in range(60)]  # copies, which have no boilerplate
    data += [(300, body(500), None), (301, f"{body(501)}\n{notice}", "elsewhere")]
    df = docs_of(data)
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert all(got[i]["kept"] and got[i]["removed_chars"] > 0 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(10))
    assert all(got[200 + i]["kept"] and not got[200 + i]["removed_chars"] for i in range(60))
    assert got[300]["kept"] and not got[301]["removed_chars"]
    left = {r["doc_id"]: r for r in quality.apply_quality(df).collect()}
    assert set(left) == {i for i, r in got.items() if r["kept"]}
    assert left[3]["text"] == body(3) and left[3]["n_chars"] == len(body(3)) and left[301]["text"].endswith(notice)
    assert quality.apply_quality(df).dtypes == df.dtypes


def test_templated_documents_are_counted_apart(spark, docs_of, words):
    """Many shared lines and one own line: all are different documents, and all are depleted."""
    shared = "\n".join(words(6, 7000 + k) for k in range(12))
    data = [(i, f"{shared}\n{words(6, 8000 + i)}") for i in range(60)]
    got = quality.quality_rules(docs_of(data)).collect()
    assert not any(r["kept"] or r["base_failed"] for r in got)
    held = quality.frequent_lines(quality.measured(docs_of(data + data))).collect()
    assert len(held) == 12 and all(r["n_docs"] == 60 for r in held)


def test_share_is_of_different_documents(spark, docs_of, words):
    """Copies on a host don't raise the limit for its other documents."""
    body = lambda s: "\n".join(words(12, 100 * s + k) for k in range(6))
    line = words(9, 9999)
    data = [(i, f"{body(i)}\n{line}" if i < 10 else body(i)) for i in range(50)] + [(100 + i, body(900)) for i in range(100)]
    got = {r["doc_id"]: r["removed_chars"] for r in quality.quality_rules(docs_of(data), min_docs=5, max_share=0.1).collect()}
    assert {i for i, n in got.items() if n} == set(range(10))


def slow_lines(data, min_docs, max_share):
    """(doc_id, removed_chars, depleted) by plain counting of the different documents that hold a line."""
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    rows = [(i, (r[0] if r else "s") or "", [norm(x) for x in (t or "").split("\n") if WORD.search(x)]) for i, t, *r in data]
    hosts, holders = {}, {}
    for _, h, lines in rows:
        if lines:
            hosts.setdefault(h, set()).add(tuple(lines))
            for x in lines:
                holders.setdefault((h, x), set()).add(tuple(lines))
    out = []
    for i, h, lines in rows:
        gone = sum(len(x) for x in set(lines) if len(holders[h, x]) > max(min_docs, max_share * len(hosts[h])))
        out.append((i, gone, 2 * gone > sum(map(len, set(lines)))))
    return out


@pytest.mark.parametrize(("min_docs", "max_share"), [(3, 0.0), (2, 0.2), (0, 0.1)])
def test_lines_against_plain_counting(spark, docs_of, min_docs, max_share):
    """One-line documents, hosts of a dozen boilerplate lines, copies, null and empty texts, ties at the limit."""
    rng = random.Random(11)
    boiler = [f"menu item {k} of many" for k in range(12)]
    data = []
    for i in range(120):
        host = rng.choice(["a", "b", None])
        lines = rng.sample(boiler, rng.randint(0, 12)) + [rng.choice(["one line", f"own {rng.randint(0, 40)} words", " \t", "ONE  line "]) for _ in range(rng.randint(0, 3))]
        data.append((i, rng.choice(["\n".join(lines)] * 9 + [None, ""]), host))
    data += [(200 + i, "just one equal line", "c") for i in range(30)] + [(300 + i, f"just one equal line\n{i % 4}", "c") for i in range(8)] + [data[5]]
    got = quality.quality_rules(docs_of(data), min_docs=min_docs, max_share=max_share).collect()
    want = slow_lines(data, min_docs, max_share)
    assert sorted((r["doc_id"], r["removed_chars"]) for r in got) == sorted(x[:2] for x in want)
    depleted = dict((x[0], x[2]) for x in want)
    assert all(r["kept"] == (not r["base_failed"] and not depleted[r["doc_id"]]) for r in got)


def test_windows_of_one_hash_are_compared(spark, docs_of, words, monkeypatch):
    """With two bits of the hash left nearly all windows collide, and the count stays exact."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(*c).bitwiseAND(F.lit(3 << 60)) if len(c) == 3 else real(*c))
    data = [(1, words(300, 1)), (2, "a b c d " * 30), (3, words(100, 2) + " " + words(100, 2)), (4, "x y z"), (5, None)]
    frame = quality.base_counts(docs_of(data)).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in frame} == {i: brute(t)[4] for i, t in data}


def test_empty(spark, docs_of):
    assert quality.quality_rules(docs_of([])).count() == 0
    assert quality.apply_quality(docs_of([(1, None)])).count() == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_url_filters", "op6_suffix_array_dedup", "op10_decontamination"])
def test_sql_agrees(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    a, b = queries.queries()[name](spark, d).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sql.OP2 == queries.oracle_sql()["op2_quality_rules"]
    cols = sorted(a.columns)
    rows = lambda x: sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in x[cols].itertuples(index=False))
    assert cols == sorted(b.columns) and rows(a) == rows(b)
