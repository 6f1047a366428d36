"""DuckDB SQL for the op queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS m FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM h JOIN f USING (k) WHERE doc_id > m),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
c AS (SELECT e.doc_id, count(r.p) AS gone, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE r.p IS NULL) AS kept FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.p = r.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {FOLDED} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS k FROM (SELECT item_id, m, w, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS s FROM b)),
v AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k FROM (SELECT doc_id, m, w, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS s FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
o AS (SELECT doc_id, s, v.m, item_id FROM v JOIN p ON v.m = p.m AND v.k = p.k),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, CAST(s + m AS BIGINT))) AS x FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 1, 2) AS BIGINT))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON u.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 100)) AS k FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 - 49 AS BIGINT))) AS s FROM d WHERE length(x) >= 100)),
f AS (SELECT k, min(doc_id) AS m FROM h GROUP BY k),
r AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS fresh FROM h JOIN f USING (k) WHERE doc_id > m),
i AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM r) GROUP BY doc_id, island),
j AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM i),
g AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last FROM i GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM j JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first_id FROM p GROUP BY x),
q AS (SELECT page_id, n, first_id, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((strpos('0123456789abcdef', substr(x, i * 5 // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, i * 5 // 4 + 2, 1)) - 1) >> (3 - i * 5 % 4)) & 31 AS BIGINT) + 1, 1)) AS c FROM p JOIN f USING (x))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(c, '') AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM q
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS w FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
g AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM f, g),
s AS (SELECT q.doc_id AS query_id, t.doc_id, sum(idf * t.tf * 2.2e0 / (t.tf + 1.2e0 * (0.25e0 + 0.75e0 * len(w) / mean))) AS score FROM t q JOIN t ON t.term = q.term JOIN i ON i.term = q.term JOIN d ON d.doc_id = t.doc_id, g WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, t.doc_id),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""

OP11 = rf"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
o AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
s AS (SELECT DISTINCT c.lang, x.p FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS p FROM (SELECT lang, a, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < len(w))) x JOIN c ON c.lang = x.lang AND c.p = x.p WHERE 100 * x.a >= 100 * c.a),
u AS (SELECT lang, p, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, CAST(k AS BIGINT))) AS j FROM c ANTI JOIN s USING (lang, p))),
v AS (SELECT u.lang, u.p AS phrase, a, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, j FROM u JOIN f l ON l.lang = u.lang AND l.p = x JOIN f r ON r.lang = u.lang AND r.p = y JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS p, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS q, CAST('0x' || x[17:24] AS BIGINT) % 100 AS a, CAST('0x' || x[25:32] AS BIGINT) % 100 AS b FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR a >= 90 THEN 'plain' WHEN b < 20 THEN 'spm' ELSE 'psm' END AS form, least(p, q) AS i, greatest(p, q) AS j FROM h),
c AS (SELECT *, substr(t, 1, i) AS prefix, substr(t, i + 1, j - i) AS middle, substr(t, j + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""

_MARKS = r"'<\\*(?:s>|/s>)|\[\\*(?:INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|/ROLE\])'"
OP13 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
t AS (SELECT conv_id, turn, role, text, length(text) + len(regexp_extract_all(text, {_MARKS})) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 13 ELSE 17 + length(role) + len(regexp_extract_all(role, {_MARKS})) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(n) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id
"""

SQL = {"op3_substrings": OP3, "op4_decontaminate": OP4, "op6_minhash": OP6, "op7_suffixes": OP7, "op8_warc": OP8, "op10_search": OP10, "op11_phrases": OP11, "op12_fim": OP12, "op13_chat": OP13}
