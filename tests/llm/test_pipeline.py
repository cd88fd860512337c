import pathlib
import re
from collections import Counter, defaultdict

import test_models
import test_packing
import test_quality
import test_suffix
from tokenizers import Tokenizer

import corpus_pipeline
from stellate import session
from stellate.llm import quality, simhash, suffix
from stellate.llm.common import fresh_path
from stellate.llm.tokens import tokenizer_path


def stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        yield name, docs, out
        docs = out


def test_stages_take_effect(spark, docs_of, words, tmp_path):
    item = words(30, 1)
    passage = words(100, 2)
    body = lambda s, n=80: "\n".join(words(n // 4, 10 * s + k) for k in range(4))
    data = [(i, body(i + 50)) for i in range(30)]
    data += [(100, "spam " * 100), (101, "short"), (102, None)]
    data += [(200 + i, body(900)) for i in range(5)] + [(200, body(900))]
    data += [(300, body(901, 200) + "\n" + passage), (301, passage + " " + body(902, 200))]
    data += [(400, body(903) + " " + item + " " + body(904))]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(data)
    seen = {}
    for name, before, after in stages(spark, docs, str(tmp_path)):
        seen[name] = after
        if name != "sequence_packing":
            assert after.dtypes == docs.dtypes
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    clean = list(range(30))
    assert ids["quality_rules"] == sorted(clean + [200, 200, 201, 202, 203, 204, 300, 301, 400])
    assert ids["simhash_near_dedup"] == [*clean, 200, 300, 301, 400]
    assert ids["suffix_array_dedup"] == [*clean, 200, 300, 301, 400]
    cut = {r["doc_id"]: r["text"] for r in seen["suffix_array_dedup"].collect()}
    assert cut[300] == body(901, 200) + "\n" and cut[301] == " " + body(902, 200) and cut[5] == body(55)
    assert ids["benchmark_decontamination"] == [*clean, 200, 300, 301]
    pieces = Counter(r["doc_id"] for r in seen["sequence_packing"].collect())
    assert set(pieces) == {*clean, 200, 300, 301}


def test_run_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    shared = pathlib.Path(session.shared_root(spark).removeprefix("file://"))
    lying = lambda: {p for k in ("*-*", "*/rdd-*") for p in shared.glob(k) if not (p / "rdd-0").exists() and p.parent.name != "_temporary"}
    before = {p for p in lying() if p.name.startswith("rdd-") or len(p.name) > 36}
    rows = corpus_pipeline.run(spark, d).collect()
    assert [p.name.rsplit("-", 1)[0] for p in lying() - before if p.name.startswith("rdd-") or len(p.name.rsplit("-", 1)[1]) == 32] == ["sequence_packing"]  # all else is cleared
    kept = {r["doc_id"] for r in rows}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert kept and kept < set(texts)
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for i in kept:
        w = " ".join(re.findall(r"[^\W_]+", texts[i].lower()))
        assert len(w.split()) >= 50 and not any(" ".join(x) in w for x in items)
    by_text = Counter(texts[i] for i in kept)
    assert max(by_text.values()) == 1
    for s in {r["sequence_id"] for r in rows[:200]}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["token_ids"])
            at += r["length"]
        assert at <= 4096


def plain_quality(rows):
    """Base counts, then lines that too many different documents of a host hold."""
    norm = lambda x: " ".join(test_quality.WORD.findall(x.lower()))
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        lines = tuple(norm(x) for x in (t or "").split("\n") if norm(x))
        if lines:
            texts[host].add(lines)
            for x in lines:
                holders[host, x].add(lines)
    often = {(h, x) for (h, x), d in holders.items() if len(d) > max(quality.LINE_MIN_DOCS, quality.LINE_MAX_SHARE * len(texts[h]))}
    out = []
    for i, t, host in rows:
        if test_quality.brute(t)[-1]:
            continue
        own = {norm(x) for x in t.split("\n")}
        gone = sum(len(x) for x in own if (host, x) in often)
        if 2 * gone <= sum(map(len, own)):
            out.append((i, "\n".join(x for x in t.split("\n") if (host, norm(x)) not in often), host))
    return out


def plain_near_copies(rows):
    """All pairs by the similarity of their sets of five words; the least id of each group stays."""
    sets = []
    for _, t, _ in rows:
        w = test_quality.WORD.findall(t.lower())
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= simhash.SIMILARITY * len(sets[x] | sets[y]):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min(least.get(g, r), r)
    return sorted(least.values())


def plain_repeats(rows):
    texts = [t.encode() for _, t, _ in rows]
    out = []
    for r, t, gone in zip(rows, texts, test_suffix.brute(texts, suffix.FLOOR), strict=True):
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.split() or not gone.any():
            out.append((r[0], left, r[2]))
    return out


def test_stages_against_plain_ones(spark, docs_of, words, tmp_path):
    """Every stage but the last in full, text for text; the last by its cover of all ids."""
    body = lambda s, n=80: "\n".join(words(n // 4, 10 * s + k) for k in range(4))
    notice, passage, item = words(60, 5), words(70, 6) + " é中🙂" * 12, words(30, 7)
    change = lambda t, *at: " ".join("zzz" if i in at else w for i, w in enumerate(t.split(" ")))
    data = [(i, body(i + 50)) for i in range(12)]
    data += [(100 + i, f"{body(i + 200)}\n{notice.upper() if i % 3 else notice}", "h") for i in range(25)]
    data += [(150 + i, f"{words(12, 4000 + i)}\n{notice}", "h") for i in range(4)] + [(160, f"{body(300)}\n{notice}", "other")]
    data += [(200 + i, change(words(200, 8), *range(i)), "s") for i in range(3)] + [(205, words(200, 8).upper()), (206, change(words(200, 8), *range(0, 200, 9))), (207, words(200, 8)), (207, words(200, 8))]
    data += [(300, f"{body(301)}\n{passage}"), (301, f"{passage} {body(302)}"), (302, passage + " " + passage[:-5])]
    data += [(400, f"{body(303)} {item} {body(304)}"), (401, f"{body(305)} {change(item, 3, 11, 20)} {body(306)}"), (402, f"{body(307)} {' '.join(item.split()[:9])}")]
    data += [(500, None), (501, ""), (502, "short"), (503, "spam " * 100), (504, "\n \t" * 80)]
    items = [(1, item), (2, None), (3, words(40, 9))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in data]
    counts = [len(want)]
    for name, before, after in stages(spark, docs_of(data), str(tmp_path)):
        if name == "sequence_packing":
            tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
            ids = {i: b"".join(k.to_bytes(4, "little") for k in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t, _ in want}
            test_packing.check(after.collect(), ids, 4096, len(ids))
            continue
        if name == "quality_rules":
            want = plain_quality(want)
        elif name == "simhash_near_dedup":
            want = plain_near_copies(want)
        elif name == "suffix_array_dedup":
            want = plain_repeats(want)
        else:
            hit = {i for i, _ in test_models.slow_overlaps([r[:2] for r in want], [x for x in items if x[1]])}
            want = [r for r in want if r[0] not in hit]
        counts.append(len(want))
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in after.collect()) == sorted(want), name
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4]
