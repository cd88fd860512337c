"""DuckDB SQL for the queries that SQL can express."""

from stellate.llm import decontam, negatives, quality, suffix, urls, warc

_WS = "[\\x20\\x09-\\x0D]+"


def _q2_parts() -> str:
    """CTEs from documents: counts, removed and verdict."""
    low = f"translate(line, '{quality.UPPER}', '{quality.LOWER}')"
    return rf"""
 d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, text IS NULL AS absent FROM documents),
 w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS words FROM d),
 grams AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
 again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
 rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
 l AS (SELECT rid, pos, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
 counts AS (SELECT d.rid, d.doc_id, d.host, d.text, len(w.words)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
   FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
 nl AS (SELECT rid, host, pos, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, length(line)::BIGINT AS chars
   FROM (SELECT d.rid, d.host, pos, trim(regexp_replace({low}, '{_WS}', ' ', 'g'), ' ') AS line FROM l JOIN d USING (rid))),
 content AS (SELECT rid, any_value(host) AS host, list(h ORDER BY pos) AS c FROM nl GROUP BY rid),
 own AS (SELECT host, c, min(rid) AS rid FROM content GROUP BY host, c),
 hl AS (SELECT DISTINCT rid, host, h, chars FROM nl),
 freq AS (SELECT host, h FROM (SELECT host, h, count(*) AS n FROM hl WHERE rid IN (SELECT rid FROM own) GROUP BY host, h) JOIN (SELECT host, count(*) AS m FROM own GROUP BY host) USING (host)
   WHERE n > {quality.LINE_MIN_DOCS} AND n > {quality.LINE_MAX_SHARE} * m),
 lost AS (SELECT rid, coalesce(sum(chars) FILTER (WHERE freq.h IS NOT NULL), 0)::BIGINT AS gone, sum(chars) AS total FROM hl LEFT JOIN freq USING (host, h) GROUP BY rid),
 judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(gone, 0)::BIGINT AS removed_chars, coalesce(2 * gone > total, false) AS depleted FROM counts LEFT JOIN lost USING (rid))"""


OP2 = f"WITH {_q2_parts()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, NOT base_failed AND NOT depleted AS kept FROM judged"


def _q4() -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, a) for a, h, p in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] == "allow"))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    link = urls.LINK.replace("'", "''")
    rounds = 150  # more than the operator takes at most
    ctes = [
        "r0 AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "r1 AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM r0)",
        f"r2 AS (SELECT page_id, html, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM r1)",
        f"r3 AS MATERIALIZED (SELECT page_id, html, host, path, {case(1)} AS rule, {case(2)} AS action FROM r2)",
        "seed AS MATERIALIZED (SELECT 't' AS kind, host, count(*)::DOUBLE AS p FROM r3 WHERE action = 'allow' AND host <> '' GROUP BY host UNION ALL SELECT 'd', host, count(*)::DOUBLE FROM r3 WHERE action = 'block' AND host <> '' GROUP BY host)",
        f"link AS (SELECT host AS src, translate(unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '{urls.UNSEEN}', ' ', 'g'), '{link}', 1)), '{urls.UPPER}', '{urls.LOWER}') AS dst FROM r3)",
        "e0 AS (SELECT src, dst, count(*) AS n FROM link WHERE src <> '' AND src <> dst GROUP BY src, dst)",
        "e1 AS (SELECT 't' AS kind, src, dst, n FROM e0 UNION ALL SELECT 'd', dst, src, n FROM e0)",
        "e AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM e1)",
        "k0 AS MATERIALIZED (SELECT kind, host, p AS r FROM seed)",
    ]
    for i in range(rounds):
        ctes.append(f"k{i + 1} AS MATERIALIZED (SELECT kind, host, {1 - urls.DAMPING} * coalesce(p, 0) + coalesce(g, 0) AS r FROM seed FULL JOIN (SELECT kind, dst AS host, {urls.DAMPING} * sum(w * r) AS g FROM e JOIN (SELECT kind, host AS src, r FROM k{i}) USING (kind, src) GROUP BY kind, dst) USING (kind, host))")
    ctes.append(f"scaled AS (SELECT kind, host, r * (SELECT sum(p) FROM seed s WHERE s.kind = k.kind) / sum(r) OVER (PARTITION BY kind) AS r FROM k{rounds} k)")
    ctes.append(f"bad AS (SELECT host FROM scaled GROUP BY host HAVING sum(CASE WHEN kind = 'd' THEN r ELSE 0 END) > {urls.THRESHOLD} * sum(r))")
    return "WITH " + ",\n".join(ctes) + " SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM r3"


OP4 = _q4()


def _covered(n: int, p: str) -> str:
    """CTEs from d: {p}span, the maximal runs of bytes that strings of n bytes cover which start twice or more."""
    return f""" {p}w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, {2 * n})) AS m FROM (SELECT rid, h, unnest(range(0, greatest(length(h) // 2 - {n - 1}, 0))) AS i FROM d)),
 {p}again AS (SELECT m FROM {p}w GROUP BY m HAVING count(*) > 1),
 {p}hit AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM {p}w WHERE m IN (SELECT m FROM {p}again)),
 {p}run AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM {p}hit),
 {p}span AS (SELECT rid, g, min(i) AS s, max(i) + {n} AS e FROM {p}run GROUP BY rid, g)"""


OP6 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
{_covered(suffix.LENGTH, "a")},
{_covered(suffix.FLOOR, "b")},
 part AS (SELECT rid, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY s) AS a, s AS b FROM aspan UNION ALL SELECT rid, max(e), NULL FROM aspan GROUP BY rid),
 kept AS (SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS k FROM part JOIN d USING (rid) GROUP BY rid),
 sums AS (SELECT rid, sum(e - s) AS n, count(*) AS c FROM aspan GROUP BY rid),
 more AS (SELECT rid, sum(e - s) AS r FROM bspan GROUP BY rid)
 SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, coalesce(r, 0)::BIGINT AS n_repeated, sha256(unhex(coalesce(k, h))) AS kept_sha256
 FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN more USING (rid)"""

OP10 = f"""WITH dw AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
 bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
 dt AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS p FROM dw), bt AS (SELECT item_id, unnest(w) AS x, unnest(range(len(w))) AS j FROM bw),
 met AS (SELECT rid, item_id, p - j AS o FROM dt JOIN bt USING (x) JOIN bw USING (item_id) GROUP BY rid, item_id, o, len(bw.w) HAVING count(*) >= least(4, len(bw.w))),
 al AS (SELECT rid, doc_id, item_id, o, len(bw.w) AS want, unnest(range(greatest(0, -o), least(len(bw.w), len(dw.w) - o))) AS j, dw.w AS d, bw.w AS b FROM met JOIN dw USING (rid) JOIN bw USING (item_id)),
 sc AS (SELECT rid, doc_id, item_id, o, want, j, d[o + j + 1] = b[j + 1] AS same FROM al),
 cu AS (SELECT *, sum(CASE WHEN same THEN {5 - decontam.SAME_OF_FIVE} ELSE -{decontam.SAME_OF_FIVE} END) OVER w AS total, sum(same::INT) OVER w AS eq FROM sc WINDOW w AS (PARTITION BY rid, item_id, o ORDER BY j)),
 wi AS (SELECT a.rid, a.doc_id, a.item_id, a.o, a.want, a.j AS s, b.j - a.j + 1 AS n, b.eq - a.eq + 1 AS q FROM cu a JOIN cu b ON a.rid = b.rid AND a.item_id = b.item_id AND a.o = b.o AND a.j <= b.j WHERE a.same AND b.same AND b.total >= a.total - {5 - decontam.SAME_OF_FIVE}),
 be AS (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY rid, item_id ORDER BY n DESC, q DESC, o, s) = 1)
 SELECT doc_id, item_id, (o + s)::BIGINT AS start, n::BIGINT AS n_words, q::BIGINT AS n_equal, true AS contaminated FROM be WHERE n >= least(want, {decontam.MIN_OVERLAP})"""


def _h(*columns: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || {c} END" for c in columns) + ")"


def _levels(name: str, base: str) -> str:
    """A recursive CTE (g, level, pos, node): the nodes of `base` (g, pos, node) and all above them."""
    return f"{name}(g, level, pos, node) AS (SELECT g, 0, pos, node FROM {base} UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, level, pos // 2)"


#: The CRC is computed bit by bit, as DuckDB has no function for it.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(list_reduce(list_prepend(xor(a, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), a >> 8))"

OP11 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS g, {_h('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
 CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_h('doc_id', 'source', 'lang', 'n_chars + 1', 'text')} ELSE {_h('doc_id', 'source', 'lang', 'n_chars', 'text')} END AS h FROM documents),
 base AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
 {_levels("tree", "base")},
 sub AS (SELECT g AS lang, level AS height, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, 0 AS g FROM (SELECT * FROM tree QUALIFY level = max(level) OVER (PARTITION BY g))),
 {_levels("over_", "sub")},
 top AS (SELECT level AS height, node FROM over_ ORDER BY level DESC LIMIT 1),
 row_ AS (SELECT base.rid, base.g, base.pos, sub.pos AS lpos, sub.height, top.height AS more, sub.node AS subroot, top.node AS root FROM base JOIN sub ON base.g IS NOT DISTINCT FROM sub.lang, top),
 step AS (SELECT s.rid, s.l AS k, xor(s.pos >> s.l, 1) < s.pos >> s.l AS is_left, t.node AS sib FROM (SELECT *, unnest(range(height)) AS l FROM row_) s LEFT JOIN tree t ON t.g IS NOT DISTINCT FROM s.g AND t.level = s.l AND t.pos = xor(s.pos >> s.l, 1)
  UNION ALL SELECT s.rid, s.height + s.l, xor(s.lpos >> s.l, 1) < s.lpos >> s.l, t.node FROM (SELECT *, unnest(range(more)) AS l FROM row_) s LEFT JOIN over_ t ON t.level = s.l AND t.pos = xor(s.lpos >> s.l, 1)),
 fold(rid, k, h) AS (SELECT rid, 0::BIGINT, h FROM d UNION ALL SELECT rid, k + 1, CASE WHEN sib IS NULL THEN sha256(h) WHEN is_left THEN sha256(sib || h) ELSE sha256(h || sib) END FROM fold JOIN step USING (rid, k)),
 proof AS (SELECT rid, sha256(coalesce(string_agg(sib, '' ORDER BY k), '')) AS p FROM row_ LEFT JOIN step USING (rid) GROUP BY rid)
 SELECT doc_id, leaf, subroot, root, p AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified FROM d JOIN row_ USING (rid) JOIN proof USING (rid) JOIN fold ON fold.rid = d.rid AND fold.k = height + more"""

OP12 = f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id, b.rid, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % {negatives.ANCHOR_EVERY} = 0),
 pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= {negatives.POSITIVES}),
 neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, row_number() OVER (PARTITION BY pos.arid, pos.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank, s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score
  FROM pos JOIN s USING (arid) WHERE NOT s.same AND {negatives.LOW} * pos.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * pos.score)
 SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {negatives.NEGATIVES}"""

OP13 = f"""WITH p AS (SELECT row_number() OVER (ORDER BY page_id) AS rid, page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
 f AS (SELECT h, arg_min(rid, (page_id, rid)) AS rid, min(page_id) AS page_id FROM p WHERE n >= {warc.MIN_PAYLOAD} GROUP BY h)
 SELECT p.page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN f.rid <> p.rid THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.rid <> p.rid THEN f.page_id END AS refers_to FROM p LEFT JOIN f USING (h)"""
