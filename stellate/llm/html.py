"""Main text of HTML pages.

A page becomes a stream of blocks, the text between block-level tags. Scripts, styles, forms, navigation, headers,
footers, sidebars, notices, adverts and reader comments are left out by their tags, roles and class or id words. Where a
page marks its article (an article or main element, or that role), the blocks inside it are candidates for the main text,
else all of them.

Then the host's pages are taken together and what repeats across its different pages goes; the unique runs stay. Each page
is a stream of tokens, each token begins a suffix, and a suffix stands by a 64-bit hash of its first tokens (DEPTH words, or
a block). These are brought together by sorting over ranges of host, hash and page, and runs of equal ones give the pages
that repeat a beginning. This is a count of hashed beginnings and no suffix array: the order is that of the hashes, and what
neighbours share is known to be one beginning or nothing. A longer repeated string is a chain of beginnings, so that the words
covered are those that an array of whole suffixes would give, which a test holds against comparison of whole strings.

* Pages without a mark: tokens are the words of the whole page, over the borders of blocks, and a string of DEPTH words or
  more that MIN_PAGES different pages hold is boilerplate.
* Pages with a mark: tokens are blocks, and a block that MIN_PAGES different pages and more than MARKED_SHARE of the host's
  different pages hold is boilerplate. Articles quote each other, so that strings of words would take wanted text.

A hot beginning spans several ranges, whose parts of a run are added up.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes, cut, written
from stellate.llm.urls import host_and_path

DEPTH, MIN_PAGES, MARKED_SHARE, SALTS = 8, 3, 0.3, 16

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"""(?<![-\w])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_UNSEEN = frozenset("noscript template svg math object canvas select".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form button dialog menu head search".split())
_ROLES = frozenset("navigation banner contentinfo complementary dialog search form alert menu menubar".split())
_DROPPED_WORDS = frozenset("ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent gdpr notice popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus footer masthead share sharing social related newsletter subscribe signup widget pagination toolbar".split())
#: Words that may stand beside those in a class or id without changing what it says.
_NEUTRAL_WORDS = frozenset("area article bar block bottom box btn button buttons col container content desktop entry fixed form global group header icon icons inner item items js large left link links list main media mobile network networks outer page panel pane post posts primary right row secondary section site slot small sticky text title tools top unit wrap wrapper".split())
_LANDMARKS = frozenset(("article", "main"))
_KEEP = frozenset(("html", "body", "article", "main"))

# Which elements end without an end tag: what opens (key) ends one of these, unless one of those lies between.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
_TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption".split())
_SCOPE = frozenset("html table td th caption template object button".split())
_OPTIONAL_END = frozenset("html head body p li dd dt tr td th tbody thead tfoot caption optgroup".split())
_ENDS_WITH_PARENT = _OPTIONAL_END | frozenset("nav footer aside menu header search".split()) | _UNSEEN


def _names_noise(value: str) -> bool:
    """Whether one of the class or id names is a left-out word, alone or with words that say no more."""
    for name in value.split():
        words = [w.lower() for w in _PART.findall(name)]
        if any(w in _DROPPED_WORDS for w in words) and all(w in _DROPPED_WORDS or w in _NEUTRAL_WORDS or w.isdigit() for w in words):
            return True
    return False


def _dropped(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is left out with all that it holds; inside: within an article."""
    if name in _DROPPED or name in _UNSEEN or name == "header" and not inside:
        return True
    if not rest or "=" not in rest or name in ("html", "body"):
        return False
    for kind, a, b, c in _ATTRIBUTE.findall(rest):
        value = a or b or c
        if kind.lower() == "role":
            if _ROLES.intersection(value.lower().split()):
                return True
        elif _names_noise(value) and (name not in _KEEP or {"comment", "comments"}.intersection(value.lower().split())):
            return True
    return False


class _Skip:
    """A left-out element: whether it was ended as it should be, and which block its first is."""

    __slots__ = ("closed", "first")

    def __init__(self):
        self.closed, self.first = True, None


def blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of a page, in order, and whether they are those of a marked article.

    Elements end as HTML says: by their end tag, where that may be missing by what follows, and at the latest with the
    element around them. Scripts and other raw text end at their own end tag only, whatever is in them. A left-out element
    whose end tag is needed and missing takes its first block only: what follows was hardly meant to be in it.
    """
    found: list[tuple[str, bool, tuple[_Skip, ...]]] = []
    parts: list[tuple[str, tuple[_Skip, ...]]] = []
    stack: list[tuple[str, _Skip | None, bool]] = []  # name, what it leaves out, whether it marks an article
    skips: tuple[_Skip, ...] = ()
    at, marks, marked = 0, 0, False

    def close():
        by: dict[tuple[_Skip, ...], list[str]] = {}
        for text, under in parts:
            by.setdefault(under, []).append(text)
        parts.clear()
        for under, texts in by.items():
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                for k in under:
                    if k.first is None:
                        k.first = len(found)
                found.append((text, marks > 0, under))

    def pop(i: int, own: bool):
        """Ends all elements from the i-th; own: that one by its end tag."""
        nonlocal skips, marks
        for k in range(len(stack) - 1, i - 1, -1):
            name, skip, mark = stack.pop()
            marks -= mark
            if skip:
                skip.closed = own and k == i or name in _ENDS_WITH_PARENT
                skips = tuple(x for x in skips if x is not skip)

    def opened(names, stop) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stop(stack[k][0]):
                break
        return -1

    m = _TAG.search(page)
    while m:
        if m.start() > at:
            parts.append((page[at : m.start()], skips))
        at = m.end()
        name = m["name"]
        if name is None:
            m = _TAG.search(page, at)
            continue
        name, rest = name.lower(), m["rest"]
        block = name in _BLOCK
        if m["close"]:
            if block:
                close()
            if block or skips:
                k = opened((name,), (lambda x: x == "table") if name in _TABLE_PARTS else (lambda x: name != "table" and x in _SCOPE and x != name))
                if k >= 0:
                    pop(k, True)
        elif name in _RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name == "br":
            parts.append((" ", skips))
        elif name in _VOID:
            if block:
                close()
        else:
            if block:
                close()
                if name not in _TABLE_PARTS:
                    k = opened(("p",), _SCOPE.__contains__)
                    if k >= 0:
                        pop(k, False)
                if name in _ENDS:
                    stop = (lambda x: x == "table") if name in _TABLE_PARTS else (lambda x: x in _BLOCK and x not in ("address", "div", "p"))
                    k = opened(_ENDS[name], stop)
                    if k >= 0:
                        pop(k, False)
            skip = _Skip() if _dropped(name, rest, marks > 0) else None
            mark = name in _LANDMARKS or "main" in rest and re.search(r"\brole\s*=\s*[\"']?main\b", rest) is not None
            if (block or skip or skips or mark) and not (rest.endswith("/") and not block):
                stack.append((name, skip, mark))
                marks += mark
                marked = marked or mark and not skips and not skip
                if skip:
                    skips = (*skips, skip)
        m = _TAG.search(page, at)
    if at < len(page):
        parts.append((page[at:], skips))
    close()
    pop(0, False)
    kept = [(t, inside) for k, (t, inside, under) in enumerate(found) if not any(x.closed or x.first == k for x in under)]
    return ([t for t, inside in kept if inside], True) if marked else ([t for t, _ in kept], False)


def _suffixes(texts: list[str], marked: bool) -> tuple[int, list[int]]:
    """A hash of the words of a page, and of each suffix that is long enough a hash of its first tokens."""
    from xxhash import xxh3_64_intdigest

    if marked:
        found = [xxh3_64_intdigest(t, 1) >> 1 for t in texts]
    else:
        w = " ".join(texts).split(" ")
        found = [xxh3_64_intdigest(" ".join(w[i : i + DEPTH])) >> 1 for i in range(len(w) - DEPTH + 1)]
    return xxh3_64_intdigest("\n".join(texts)) >> 1, found


def _row_key(*columns: str):
    """Equal rows share it; a null differs from an empty text, and in which column it stands counts."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, key, host, texts, marked, content, suffixes), from a table in the shared folder."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _row_key(id_col, url_col, html_col).alias("key"), host_and_path(F.col(url_col))[0].alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        for b in by_bytes(batches, "html"):
            got = [blocks(t) for t in b.column(4).to_pylist()]
            more = [_suffixes(t, marked) for t, marked in got]
            cols = [pa.array([t for t, _ in got], pa.list_(pa.string())), pa.array([m for _, m in got]), pa.array([h for h, _ in more], pa.int64()), pa.array([s for _, s in more], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], ["id", "url", "key", "host", "texts", "marked", "content", "suffixes"])

    return written(bounded_batches(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, url {src.schema['url'].dataType.simpleString()}, key long, host string, texts array<string>, marked boolean, content long, suffixes array<long>"), "parsed")[0]


def beginnings(parsed: DataFrame) -> DataFrame:
    """(host, marked, suffix, content): the suffixes of each host, sorted over ranges of rows. Of pages with equal texts one
    is taken, and of a beginning that a page repeats the first, so that no row comes twice and no range has to be long."""
    pages = parsed.groupBy("host", "marked", "content").agg(F.first("suffixes").alias("suffixes"))
    each = pages.select("host", "marked", F.explode(F.array_distinct("suffixes")).alias("suffix"), "content")
    return each.repartitionByRange(*each.columns).sortWithinPartitions(*each.columns)


def _intervals(min_pages: int):
    """Sorted (host, marked, suffix, content) -> (host, marked, suffix, n): runs of neighbours with an equal beginning, n the
    pages in them. Short ones are left out, but not the first and the last of a range, which may go on in the next."""

    def run(batches):
        held = None  # the run at the end of what was read; the first of the range is never short
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            host, marked, suffix = (b.column(i) for i in range(3))
            new = np.ones(b.num_rows, bool)
            new[1:] = False
            for c in (host, marked, suffix):
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            n = np.diff(np.append(starts, b.num_rows))
            name = lambda k: tuple(c[int(starts[k])].as_py() for c in (host, marked, suffix))
            out = []
            if held and held[0] == name(0):
                n[0] += held[1]
            elif held:
                out.append((*held[0], held[1]))
                first = False
            long = n[:-1] >= min_pages
            if first and len(long):
                long[0], first = True, False
            out += [(*name(k), int(n[k])) for k in np.flatnonzero(long)]
            held = name(len(n) - 1), int(n[-1])
            if out:
                yield _run_rows(out)
        if held:
            yield _run_rows([(*held[0], held[1])])

    return run


def _run_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "marked", "suffix", "n"])


def boilerplate(parsed: DataFrame, min_pages: int = MIN_PAGES, marked_share: float = MARKED_SHARE) -> DataFrame:
    """(key, covered): the places of the suffixes whose beginning is boilerplate. Copies of a page count as one."""
    each = parsed.select("key", "host", "marked", F.posexplode("suffixes").alias("at", "suffix"))
    hosts = cut(parsed.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    runs = bounded_batches(beginnings(parsed)).mapInArrow(_intervals(min_pages), "host string, marked boolean, suffix long, n long")
    often = runs.groupBy("host", "marked", "suffix").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages)
    common = cut(often.join(hosts, "host").filter(~F.col("marked") | (F.col("n") > marked_share * F.col("pages"))))
    salted = common.select("host", "marked", "suffix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = each.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["host", "marked", "suffix", "salt"])
    return hits.groupBy("key").agg(F.collect_set("at").alias("covered"))


def _unique_runs(batches):
    """(id, url, texts, marked, covered) -> text without what is covered"""
    for b in batches:
        out = []
        for texts, marked, covered in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if covered and marked:
                gone = set(covered)
                texts = [t for i, t in enumerate(texts) if i not in gone]
            elif covered:
                n = sum(t.count(" ") + 1 for t in texts)
                cover = np.zeros(n + DEPTH, bool)
                for k in range(DEPTH):
                    cover[np.array(covered) + k] = True
                at, left = 0, []
                for t in texts:
                    w = t.split(" ")
                    left.append(" ".join(x for x, g in zip(w, cover[at : at + len(w)].tolist(), strict=True) if not g))
                    at += len(w)
                texts = [t for t in left if t]
            out.append("\n".join(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, marked_share: float = MARKED_SHARE) -> DataFrame:
    """One row for each row of `pages`: the id, the url, text and n_chars.

    A null page is empty, as is one without text outside what is left out. A null url belongs to the host ''. Copies of
    a page count as one when repeats are counted; equal rows get equal texts; a block on exactly `marked_share` of a
    host's pages stays. Extra columns are not read.
    """
    parsed = parse(pages, id_col, url_col, html_col)
    covered = cut(boilerplate(parsed, min_pages, marked_share))
    src = parsed.select("id", "url", "texts", "marked", "key")
    if covered.isEmpty():
        src = src.select("id", "url", "texts", "marked", F.lit(None).cast("array<int>").alias("covered"))
    else:
        src = src.join(covered, "key", "left").select("id", "url", "texts", "marked", "covered")
    out = bounded_batches(src).mapInArrow(_unique_runs, f"id {parsed.schema['id'].dataType.simpleString()}, url {parsed.schema['url'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
