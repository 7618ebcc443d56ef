"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, MENU

_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM r),
rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
h AS (SELECT p.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp) GROUP BY p.page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN h USING (page_id)"""

_W = r"'[^\x20\x09-\x0D]+'"
_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
_MENU = ", ".join(f"'{w}'" for w in MENU)

OP3 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_W}) AS w FROM d),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
lw AS (SELECT *, regexp_extract_all(line, {_W}) AS ws, lower(line) AS low FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup FROM lw),
lf AS (SELECT doc_id, len(ws) AS n, dup, len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.25 * len(ws) OR len(list_filter(ws, lambda x: ends_with(rtrim(x, '.,'), '!!'))) > 0.5 * len(ws) OR len(regexp_extract_all(line, ' (\||>|») ')) >= 3
 OR (len(ws) <= 15 AND ({_PHRASES})) OR (len(ws) <= 15 AND len(list_filter(regexp_extract_all(low, {_W}), lambda x: x NOT IN ({_MENU}))) = 0) AS fails FROM lr),
ls AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup, sum(n) FILTER (WHERE NOT dup AND NOT fails) AS n_kept FROM lf GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_kept, 0) AS n_kept_words
 FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ls USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_kept_words <= 0.5 * n_words AS kept, CAST(n_kept_words AS BIGINT) AS n_kept_words FROM f"""

OP4 = rf"""WITH t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents)),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM t QUALIFY i <= n - 19),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
m AS (SELECT t.doc_id, t.i, t.word, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.i),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

OP7 = f"""WITH bt AS (SELECT item_id, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) AS j FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark)),
b4 AS (SELECT item_id, n, j, tok || ' ' || lead(tok, 1) OVER p || ' ' || lead(tok, 2) OVER p || ' ' || lead(tok, 3) OVER p AS k FROM bt WINDOW p AS (PARTITION BY item_id ORDER BY j)),
dt AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)),
d4 AS (SELECT doc_id, i, tok || ' ' || lead(tok, 1) OVER p || ' ' || lead(tok, 2) OVER p || ' ' || lead(tok, 3) OVER p AS k FROM dt WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
diag AS (SELECT DISTINCT doc_id, item_id, n, i - j AS shift FROM d4 JOIN b4 ON d4.k = b4.k),
eq AS (SELECT g.doc_id, g.item_id, g.n, g.shift, b.j, CAST(d.tok = b.tok AS INT) AS same FROM diag g JOIN bt b ON b.item_id = g.item_id LEFT JOIN dt d ON d.doc_id = g.doc_id AND d.i = b.j + g.shift),
win AS (SELECT doc_id, item_id, least(n, 13) AS len, j, n, sum(coalesce(same, 0)) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS agree FROM eq)
SELECT doc_id, item_id, CAST(max(len) AS BIGINT) AS "window", CAST(max(agree) AS BIGINT) AS best_overlap FROM win WHERE j <= n - len + 1 AND agree >= ceil(0.8 * len) GROUP BY doc_id, item_id"""

OP11 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM t),
p AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_BASE32 = " || ".join(f"translate(to_base(CAST('0x' || substr(d, {1 + 10 * k}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for k in range(4))

OP12 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""

_CRC = "list_reduce(list_concat([4294967295::UBIGINT], list_concat(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_concat([ascii(x)::UBIGINT], list_transform(range(8), lambda k: 1000::UBIGINT)))))), lambda c, x: CASE WHEN x < 1000 THEN xor(c, x) ELSE xor(c >> 1, (c & 1::UBIGINT) * 3988292384::UBIGINT) END)"

OP13 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(pos) AS own, conv_id - conv_id % 5 AS base, CAST(xor({_CRC}, 4294967295::UBIGINT) % 9 AS BIGINT) AS h FROM t GROUP BY conv_id),
f AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS given FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
r AS (SELECT f.conv_id, given + pos - h AS d, mark, size FROM t JOIN f ON t.conv_id = f.conv_id WHERE pos > h UNION ALL SELECT f.conv_id, pos, mark, size FROM t JOIN f ON t.conv_id = f.base WHERE pos <= given),
p AS (SELECT conv_id, d, size, sha256(string_agg(mark, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM f),
n AS (SELECT d, k, min(conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM p GROUP BY d, k),
w AS (SELECT n.*, q.k AS pk, q.owner AS parent FROM n LEFT JOIN p ON p.conv_id = n.owner AND p.d = n.d - 1 LEFT JOIN n AS q ON q.d = p.d AND q.k = p.k),
ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM w WHERE d > 0 GROUP BY ALL),
v AS (SELECT w.*, coalesce(ch.n, 0) AS n_children FROM w LEFT JOIN ch ON ch.d = w.d AND ch.k = w.k),
s AS (SELECT p.d, p.k, sum(v.saved) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS leaves FROM v JOIN p ON p.conv_id = v.owner AND p.d <= v.d GROUP BY ALL),
e AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) USING (conv_id, d) GROUP BY d, k)
SELECT v.owner AS conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN s ON s.d = v.d AND s.k = v.k LEFT JOIN e ON e.d = v.d AND e.k = v.k"""

ORACLES = {"op2_url_filter": OP2, "op3_quality_rules": OP3, "op4_substring_dedup": OP4, "op7_decontamination": OP7, "op11_fill_in_middle": OP11, "op12_warc_zip": OP12, "op13_prefix_trie": OP13}
