import html as H
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stellate.llm import decontam, html, langid, queries


def vocabulary(letters, seed):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(200)]


def test_language_identification(spark):
    sets = {"aa": vocabulary("abcdefé", 1), "bb": vocabulary("defghiü", 2), "cc": vocabulary("ghijklñ", 3)}
    r = random.Random(4)
    rows = []
    for i in range(400):
        lang = r.choice(list(sets))
        rows.append((i, " ".join(r.choice(sets[lang]) for _ in range(r.randint(3, 120))), lang, "x"))
    rows += [(900, None, "aa", "x"), (901, "12 34 !", "aa", "x"), (902, "", None, "x"), (903, "  ", "dd", None), (905, "½ ² Ⅷ ①", "aa", "x"), (906, "½" * 5000 + "_", "aa", "x"), (904, rows[0][1] * 200, None, "x"), (None, rows[0][1], "bb", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got}
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(400) if by[i]["held_out"]} == set(out)
    assert np.mean([by[i]["lang_pred"] == rows[i][2] for i in out]) > 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902, 903, 905, 906))
    assert by[904]["lang_pred"] == by[0]["lang_pred"] and not by[None]["held_out"]
    assert all(0 <= g["score"] <= 1 for g in got)
    again = {g["doc_id"]: tuple(g) for g in langid.identify(df).collect()}
    assert again == {k: tuple(v) for k, v in by.items()}
    nothing = langid.identify(df.withColumn("lang", df["h"].substr(9, 1)).filter("lang = 'zz' or doc_id is not null").selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {g["lang_pred"] for g in nothing.collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def slow_predict(net, text):
    """Window by window, filter by filter, place by place."""
    p, own = net.p, np.repeat(langid.WIDTHS, langid.FILTERS)
    total, data = np.zeros(len(net.labels)), text.encode()
    starts = range(0, max(len(data), 1), langid.WINDOW)
    for s in starts:
        w = data[s : s + langid.WINDOW].ljust(langid.WINDOW + net.wide - 1, b"\0")
        act = [max(0.0, max(sum(float(p["embed"][w[i + k]] @ p["conv"][k, :, f]) for k in range(own[f])) for i in range(langid.WINDOW)) + float(p["bias"][f])) for f in range(len(own))]
        total += np.array(act) @ p["out"] + p["shift"]
    e = np.exp(total / len(starts) - (total / len(starts)).max())
    return net.labels[int(e.argmax())], e.max() / e.sum()


def test_predictions_against_a_plain_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.train(docs, train_docs=40)
    got = {r["doc_id"]: r for r in langid.identify(docs, train_docs=40).collect()}
    for r in docs.filter("length(text) between 3 and 700").orderBy("doc_id").limit(12).collect():
        lang, score = slow_predict(net, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 1e-4


def test_gradients_are_right():
    net = langid.ByteCNN(["a", "b"])
    rng = np.random.default_rng(0)
    rows, y = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        top = net._responses(rows)[1].max(axis=1)
        s = np.maximum(top + net.p["bias"], 0) @ net.p["out"] + net.p["shift"]
        return -np.mean((s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(5), y])

    g = net.gradients(rows, y)
    for k, v in net.p.items():
        for at in rng.choice(v.size, 12):
            i = np.unravel_index(at, v.shape)
            if k == "conv" and not net.mask[i]:
                continue
            old, eps = v[i], 1e-5
            v[i] = old + eps
            up = loss()
            v[i] = old - eps
            down = loss()
            v[i] = old
            assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-4


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r["lang_pred"] == lang[r["doc_id"]] for r in queries.op8_language_id(spark, d).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean(got) > 0.97


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="page has-sidebar"><header>site</header><nav><ul><li>menu</li></ul></nav><div class="cookie-notice"><div>ok?</div></div>
<article data-x="a>b"><h1>Title &amp; more</h1><p>One <b>bold</b>word<br>next&nbsp;line</p><!-- <p>no</p> --><div class='ad'>buy<div>now</div></div>
<aside>side</aside><p>Unclosed <p>Two &lt;x&gt; &eacute;<form>q<input></form><ul><li>a<li>b</ul><section id="comments"><p>troll</p></section></article>
<p>below</p><footer>&copy; x</footer></body></html>"""


def test_blocks():
    assert html.blocks(PAGE) == (["Title & more", "One boldword next line", "Unclosed", "Two <x> é", "a", "b"], True)
    assert html.blocks("") == ([], False)
    assert html.blocks("plain &am text") == (["plain &am text"], False)
    assert html.blocks("<p>a<script>never closed") == (["a"], False)
    assert html.blocks("<main><p>in</main><p>out") == (["in"], True)
    assert html.blocks("<p title='<b>'>x</p> < 3 <") == (["x", "< 3 <"], False)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p>one</p><script>for(i=0;i<n;i++){x="1"}</script><p>two</p></article>', ["one", "two"]),
        ("<p>a<style>b < c { }</STYLE >d", ["ad"]),
        ('<article><p class="notice">ad<p>real text one<p>real two</article>', ["real text one", "real two"]),
        ('<ul><li class="share">x<li>keep a<li>keep b</ul><p>tail</p>', ["keep a", "keep b", "tail"]),
        ('<table><tr><td class="ad">x<td>y<tr><td>z</table>', ["y", "z"]),
        ('<p>a</p><div class="ad">buy<p>text</p><p>more</p>', ["a", "text", "more"]),
        ('<article><div class="ad">buy<p>k</p></article><p>z</p>', ["k"]),
        ('<div><div class="ad"><p>z</p><div>y</div></div><p>t</p></div>', ["t"]),
        ('<article><h2 class="social-history">S</h2><p class="notice-of-meeting">N</p><p class="share-buttons">B</p></article>', ["S", "N"]),
        ('<div class="page with-sidebar"><p>x</p><div id="main-nav">m</div></div>', ["x"]),
        ('<p>One <span class="ad">x <span>y</span></span> two</p>', ["One two"]),
        ('<p data-class="ad" aria-role="menu">k</p><nav>m<p>n</nav>q', ["k", "q"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul></div></p>d", ["a", "b", "c", "d"]),
        ("<article><p>x</p><form>y</article></form><p>below", ["x"]),
    ],
)
def test_left_out_elements_end(page, want):
    assert html.blocks(page)[0] == want


def test_rows_that_differ_in_where_the_null_is(spark):
    rows = [(1, None, "x"), (1, "x", None)]
    got = html.parse(spark.createDataFrame(rows, "page_id long, url string, html string")).select("key").distinct().count()
    assert got == 2


def test_host_repeats(spark, words):
    line = "share this story with all of your friends and also subscribe today"
    rows = [(i, f"http://a.io/{i}", f"<p>{words(30, i)}</p><p>{words(12, 50 + i)} {line}</p>") for i in range(5)]
    rows += [(10 + i, "http://b.io/x", f"<p>{words(40, 77)}</p>") for i in range(6)]  # copies of one page
    rows += [(20 + i, f"http://c.io/{i}", f"<article><p>{line} {words(9, i)}</p></article>") for i in range(5)]
    rows += [(40 + i, f"http://e.io/{i}", f"<article><p>{words(30, 300 + i)}</p><div>{line}</div></article>" if i < 4 else f"<article><p>{words(30, 300 + i)}</p></article>") for i in range(12)]
    rows += [(60 + i, f"http://f.io/{i}", f"<ul><li>Home<li>News<li>Contact us<li>About<li>Jobs now</ul><p>{words(20, 400 + i)}</p><p>(c) 2024 Example</p>") for i in range(4)]
    rows += [(30, None, None), (31, "http://a.io/", ""), (30, None, None), (32, "http://d.io/", f"<p>{line}</p>")]
    got = {}
    for r in html.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, texts string, key string")).collect():
        got[r["page_id"]] = r["text"]
        assert r["n_chars"] == len(r["text"])
    for i in range(5):
        assert got[i] == f"{words(30, i)}\n{words(12, 50 + i)}"
        assert got[20 + i] == f"{line} {words(9, i)}"
    for i in range(12):  # a block on a third of the marked pages goes
        assert got[40 + i] == words(30, 300 + i)
    for i in range(4):  # words are counted over the borders of blocks, but a repeat of fewer than eight stays
        assert got[60 + i] == f"Home\nNews\nContact us\nAbout\nJobs now\n{words(20, 400 + i)}\n(c) 2024 Example"
    assert got[10] == words(40, 77) and got[30] == got[31] == "" and got[32] == line
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def slow_extract(rows, min_pages, share):
    """Covered words and blocks by comparing whole strings of all pages of a host."""
    parsed = [(i, re.match(r"\w+://([^/]*)", u or "")[1] if u else "", *html.blocks(h or "")) for i, u, h in rows]
    holders, pages = defaultdict(set), defaultdict(set)
    for _, host, texts, marked in parsed:
        w = " ".join(texts).split(" ")
        pages[host].add(tuple(texts))
        for x in texts if marked else [tuple(w[i : i + html.DEPTH]) for i in range(len(w) - html.DEPTH + 1)]:
            holders[host, marked, x].add(tuple(texts))
    out = []
    for i, host, texts, marked in parsed:
        if marked:
            kept = [t for t in texts if len(holders[host, True, t]) < min_pages or len(holders[host, True, t]) <= share * len(pages[host])]
        else:
            flat = [(b, x) for b, t in enumerate(texts) for x in t.split(" ")]
            gone = {k + j for k in range(len(flat) - html.DEPTH + 1) if len(holders[host, False, tuple(x for _, x in flat[k : k + html.DEPTH])]) >= min_pages for j in range(html.DEPTH)}
            left = [" ".join(x for k, (c, x) in enumerate(flat) if c == b and k not in gone) for b in range(len(texts))]
            kept = [t for t in left if t]
        out.append((i, "\n".join(kept)))
    return out


def test_pages_against_whole_strings(spark, words):
    rng = np.random.default_rng(5)
    boiler = [words(int(n), 600 + k) for k, n in enumerate(rng.integers(1, 15, 12))]
    rows = []
    for i in range(150):
        parts = [boiler[rng.integers(0, 12)] if rng.random() < 0.5 else words(int(rng.integers(1, 12)), 700 + int(rng.integers(0, 200))) for _ in range(rng.integers(0, 7))]
        body = "".join(f"<p>{x}</p>" for x in parts)
        rows.append((i, f"http://h{i % 3}.org/{i}" if i % 11 else None, f"<article>{body}</article>" if i % 2 else body or None))
    rows += rows[:5]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), marked_share=0.1).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(slow_extract(rows, html.MIN_PAGES, 0.1))


def test_intervals_over_ranges_and_batches():
    rng = np.random.default_rng(3)
    rows = sorted({(f"h{rng.integers(0, 3)}", bool(rng.integers(0, 2)), int(rng.zipf(1.3)) % 20, int(rng.integers(0, 60))) for _ in range(700)})
    want = Counter(r[:3] for r in rows)
    for ranges, size in [(1, 1000), (1, 1), (3, 7), (40, 5), (len(rows), 1)]:
        got = Counter()
        for k in range(ranges):
            part = rows[k * len(rows) // ranges : (k + 1) * len(rows) // ranges]
            batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*part[i : i + size], strict=True)], ["host", "marked", "suffix", "content"]) for i in range(0, len(part), size)]
            for b in html._intervals(4)(batches):
                for r in b.to_pylist():
                    got[r["host"], r["marked"], r["suffix"]] += r["n"]
        assert {k: n for k, n in got.items() if n >= 4} == {k: n for k, n in want.items() if n >= 4}


def test_pages_of_the_test_data(spark):
    d = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in queries.op9_html_extraction(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow_overlaps(docs, items):
    out = {}
    for i, t in docs:
        w = tokens(t)
        for k, b in items:
            b = tokens(b)
            place = defaultdict(list)
            for j, x in enumerate(b):
                place[x].append(j)
            best = 0
            for at, n in Counter(p - j for p, x in enumerate(w) for j in place.get(x, ())).items():
                if n >= min(4, len(b)):
                    same = np.array([w[at + j] == b[j] for j in range(max(0, -at), min(len(b), len(w) - at))])
                    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
                    best = max([best, *(j - i + 0 for i in range(len(total)) for j in range(i + 1, len(total)) if total[j] >= total[i] and same[i] and same[j - 1])])
            if b and best >= min(len(b), 13):
                out[i, k] = max(best, out.get((i, k), 0))
    return out


@pytest.mark.parametrize("block", [500_000, 20])
def test_decontamination(spark, docs_of, words, block):
    items = [(k, words(n, 1000 + k)) for k, n in enumerate([5, 9, 15, 30, 60, 3])] + [(6, None), (7, ""), (8, words(30, 1003))]
    change = lambda t, *at: " ".join("zzz" if i in at else w for i, w in enumerate(t.split()))
    docs = [(i, words(80, i)) for i in range(20)]
    for k in range(6):
        docs.append((100 + k, f"{words(20, 200 + k)}, {items[k][1].upper()}! {words(20, 300 + k)}"))
    docs += [(120, change(items[4][1], *range(4, 60, 5))), (121, change(items[3][1], 3, 9, 17)), (122, " ".join(items[4][1].split()[20:36])), (123, change(items[2][1], 1, 5, 9, 12)), (124, None), (125, ""), (126, items[2][1]), (126, items[2][1]), (127, words(20_000, 9) + " " + items[3][1])]
    short = {n: " ".join(f"q{n}x{k}" for k in range(n)) for n in range(1, 9)}
    items += [(20 + n, t) for n, t in short.items()]
    docs += [(1000 + 10 * n + k, f"{words(5, n)} {change(t, k)} {words(5, k)}") for n, t in short.items() for k in range(n + 1)]
    df, bench = docs_of(docs, clash=True), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_words int")
    got = decontam.find_overlaps(df, bench, block_words=block).collect()
    assert sum(r["doc_id"] == 126 for r in got) == 2
    want = slow_overlaps(docs, [x for x in items if x[1]])
    assert {(r["doc_id"], r["item_id"]): r["n_words"] for r in got} == want
    assert {r["doc_id"] for r in got if r["doc_id"] < 1000} == {100, 101, 102, 103, 104, 105, 120, 121, 122, 126, 127}
    for n in range(1, 9):  # one changed word leaves 80 % of five or more, and an overlap ends with equal words
        assert [k for k in range(n + 1) if (1000 + 10 * n + k, 20 + n) in want] == [k for k in range(n + 1) if k == n or n >= 5 and 0 < k < n - 1]
    left = decontam.drop_contaminated(df, bench, block_words=block)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in docs if i not in {r["doc_id"] for r in got})
    assert left.dtypes == df.dtypes
    assert decontam.find_overlaps(df, bench.limit(0)).count() == 0 and decontam.find_overlaps(df.limit(0), bench).count() == 0


def test_repetitive_texts_are_laid_out_in_parts(monkeypatch):
    index = decontam.SeedIndex([np.full(200, 7, np.uint64), np.array([3], np.uint64)])
    words, ends = np.full(3000, 7, np.uint64), np.array([0, 3000])
    want = index.overlaps(words, ends)
    monkeypatch.setattr(decontam, "HITS", 1000)
    assert index.overlaps(words, ends) == want == [(0, 0, 0, 200, 200)]
    at = index.alignments(words, ends)
    assert len(at[2]) == 3000 + 200 - 2 * 5 + 1 and at[2].min() == 5 - 200


def test_masks_meet_all_patterns():
    from itertools import combinations

    for n, k in [(15, 3), *((n, 2) for n in range(10, 15)), (8, 1), (9, 1)]:
        for gone in combinations(range(n), k):
            assert any(all(i + o not in gone for o in m) for m in decontam.MASKS for i in range(n - m[-1]))


def test_words(spark):
    h, at = decontam.words_of(pa.array(["A b", None, "--", "É.é", "b_b"]))
    assert at.tolist() == [0, 2, 2, 2, 4, 6] and h[2] == h[3] and h[1] == h[4] == h[5]
