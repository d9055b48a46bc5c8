"""SQL for the rows of those corpus queries that SQL can express."""

from __future__ import annotations

from noticeloom.llm.url_filter import DEVIATIONS, STRONGEST, SUFFIXES, THRESHOLD, WEAKEST

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND 2 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 10 * n_dup_lines <= 3 * len(string_split(t, chr(10)))
 AND 10 * len(regexp_replace(t, '[^\pL]+', '', 'g')) >= 6 * word_chars AND 10 * len(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) <= 5 * word_chars AND 5 * len(regexp_replace(t, '[^!?]+', '', 'g')) <= n_words AS kept FROM b"""


def _strength(level: str, prior: str) -> str:
    p = f"least(greatest({prior}, 0.01), 0.99)"
    rho = f"(sum((good - n * {p}) * (good - n * {p})) - sum(n * {p} * (1 - {p}))) / nullif(sum(n * (n - 1) * {p} * (1 - {p})), 0)"
    return f"(SELECT CASE WHEN {rho} > 0 THEN least(greatest(1 / ({rho}) - 1, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END FROM {level})"


URLS = f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u),
k AS (SELECT *, string_split(name, '.') AS ps, array_to_string(string_split(name, '.')[-2:], '.') AS two, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(name, '[') AS numbers
 FROM (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '[.]?(:[0-9]*)?$', '') AS name FROM r)),
x AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled, CASE WHEN numbers THEN name WHEN two IN {SUFFIXES} THEN two ELSE ps[-1] END AS suffix,
 CASE WHEN numbers THEN name WHEN two IN {SUFFIXES} THEN array_to_string(ps[-3:], '.') ELSE two END AS domain FROM k),
h0 AS (SELECT name, domain, suffix, count(*)::DOUBLE AS n, sum(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good FROM x WHERE ruled IS NOT NULL GROUP BY ALL),
p AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p0 FROM h0),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT p0 FROM p) AS p0 FROM h0 GROUP BY suffix),
s AS (SELECT suffix, (good + m * p0) / (n + m) AS sp, n + m AS ss FROM (SELECT *, {_strength('s0', 'p0')} AS m FROM s0)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(sp) AS sp FROM h0 JOIN s USING (suffix) GROUP BY ALL),
d AS (SELECT domain, (good + m * sp) / (n + m) AS dp, n + m AS ds FROM (SELECT *, {_strength('d0', 'sp')} AS m FROM d0)),
h1 AS (SELECT name, n, good, dp FROM h0 JOIN d USING (domain)),
h AS (SELECT name, (good + m * dp) / (n + m) AS hp, n + m AS hs FROM (SELECT *, {_strength('h1', 'dp')} AS m FROM h1)),
j AS (SELECT x.*, coalesce(hp, dp, sp, (SELECT p0 FROM p)) AS q, coalesce(hs, ds, ss, {WEAKEST}) AS size FROM x LEFT JOIN h USING (name) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN q - {DEVIATIONS} * sqrt(q * (1 - q) / (size + 1)) >= {THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict FROM j"""

NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT p.a, p.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS k FROM s JOIN s t ON s.x = t.x AND s.doc_id <> t.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
c(doc_id, r) AS (SELECT a, a FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a),
m AS (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.r, w.doc_id) AS component_id, coalesce(m.r, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

FIM = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = rf"""WITH t AS (SELECT doc_id, {_TERMS} AS ts FROM documents), s AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM t WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM s), p AS (SELECT doc_id, n, x, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS x FROM s) GROUP BY ALL),
w AS (SELECT x, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT x, count(*)::BIGINT AS df FROM p GROUP BY x), g),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS x FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score FROM q JOIN w USING (x) JOIN p USING (x), g GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r QUALIFY rank <= 50"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.93),
c(vec_id, r) AS (SELECT a, a FROM e UNION SELECT c.vec_id, e.b FROM c JOIN e ON c.r = e.a),
m AS (SELECT vec_id, min(r) AS r FROM c GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.r, x.vec_id) AS component_id, coalesce(m.r, x.vec_id) = x.vec_id AS kept FROM embeddings x LEFT JOIN n ON n.a = x.vec_id LEFT JOIN m ON m.vec_id = x.vec_id"""

ORACLES = {"op1_warc": WARC, "op5_quality_rules": QUALITY, "op6_url_filter": URLS, "op9_near_duplicates": NEAR, "op11_fill_in_middle": FIM, "op12_vector_groups": VECTORS, "op13_ranked_search": RANKED}
