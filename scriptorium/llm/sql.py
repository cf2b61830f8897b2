"""DuckDB SQL for the operators that SQL can express."""

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Counts of one relation `src` (doc_id, lang, source, t), t not null, as relation `feat`.
_FEATURES = rf"""
words AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, {_WORD}) AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM src),
win AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM twice) GROUP BY rid),
feat AS (SELECT words.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ln)::BIGINT AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter,
  (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN rep ON rep.rid = words.rid),
base AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (n_symbols * 1000) // greatest(n_words, 1) AS v1, (word_chars * 100) // greatest(n_words, 1) AS v2,
  (n_dup_lines * 1000) // greatest(n_lines, 1) AS v3, (n_stutter * 1000) // greatest(n_words, 1) AS v4 FROM feat),
vals AS (SELECT lang, source, r, v FROM (SELECT lang, source, unnest([1, 2, 3, 4]) AS r, unnest([v1, v2, v3, v4]) AS v FROM base WHERE NOT base_failed)),
bk AS (SELECT lang, source, r, (v // (1::BIGINT << greatest(length(bin(v)) - 7, 0))) * (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS b FROM vals),
f AS (SELECT lang, source, r, count(*) AS n, quantile_disc(b, 0.25) AS a, quantile_disc(b, 0.5) AS h, quantile_disc(b, 0.75) AS z FROM bk GROUP BY 1, 2, 3),
m AS (SELECT lang, r, count(*) AS n, quantile_disc(b, 0.25) AS a, quantile_disc(b, 0.5) AS h, quantile_disc(b, 0.75) AS z FROM bk GROUP BY 1, 2),
g AS (SELECT r, quantile_disc(b, 0.25) AS a, quantile_disc(b, 0.5) AS h, quantile_disc(b, 0.75) AS z FROM bk GROUP BY 1),
l AS (SELECT lang, m.r, (m.a * n + g.a * 10) // (n + 10) AS a, (m.h * n + g.h * 10) // (n + 10) AS h, (m.z * n + g.z * 10) // (n + 10) AS z FROM m JOIN g ON g.r = m.r),
q AS (SELECT f.lang, f.source, f.r, (f.a * n + l.a * 10) // (n + 10) AS q25, (f.h * n + l.h * 10) // (n + 10) AS q50, (f.z * n + l.z * 10) // (n + 10) AS q75
  FROM f JOIN l ON l.lang IS NOT DISTINCT FROM f.lang AND l.r = f.r),
e AS (SELECT lang, source, r, q75 + 16 * greatest(q75 - q50, q50 // 64, 1) AS hi, q25 - 16 * greatest(q50 - q25, q50 // 64, 1) AS lo FROM q),
lim AS (SELECT lang, source,
  max(CASE WHEN r = 1 THEN greatest(hi, 100) END) AS h1, max(CASE WHEN r = 2 THEN hi END) AS h2, max(CASE WHEN r = 2 THEN lo END) AS l2,
  max(CASE WHEN r = 3 THEN greatest(hi, 500) END) AS h3, max(CASE WHEN r = 4 THEN greatest(hi, 100) END) AS h4 FROM e GROUP BY 1, 2),
judged AS (SELECT base.*, NOT base_failed AND coalesce(v1 <= h1 AND v2 <= h2 AND v2 >= l2 AND v3 <= h3 AND v4 <= h4, true) AS kept
  FROM base LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM base.lang AND lim.source IS NOT DISTINCT FROM base.source)"""

QUALITY_SQL = f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
{_FEATURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

DECONTAMINATION_SQL = r"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
dw AS (SELECT rid, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
bw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bn),
dn AS (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT dn.rid, dn.i, dn.n, bn.item_id FROM dn JOIN bn ON bn.n = dn.n AND bn.k = dn.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.rid = dw.rid LEFT JOIN ids ON ids.rid = dw.rid"""

CHAT_SQL = """
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (SELECT conv_id, alone, list({'role': role, 'text': text} ORDER BY i) AS turns, max(CASE WHEN role = 'assistant' THEN i END) AS la, count(*) AS k FROM n GROUP BY conv_id, alone),
o AS (SELECT c.conv_id, turns, coalesce(la, k) AS last, (SELECT max(i) FROM n WHERE n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.alone IS NOT DISTINCT FROM c.alone AND n.role = 'assistant' AND n.i < la) AS other FROM c),
p AS (SELECT conv_id, turns AS ch, CASE WHEN other IS NOT NULL THEN list_concat(turns[1:last-1], [turns[other]]) ELSE turns[1:last-1] END AS rj FROM o),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(ch), len(rj)) + 1), lambda i: ch[i] IS DISTINCT FROM rj[i])) - 1, least(len(ch), len(rj))) AS m FROM p),
r AS (SELECT conv_id, m, ch[1:m] AS pr, ch[m+1:] AS c2, rj[m+1:] AS r2 FROM q),
s AS (SELECT *, list_transform(pr, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS sp,
  list_transform(c2, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS sc,
  list_transform(r2, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS sr FROM r),
z AS (SELECT *, list_filter(range(1, len(c2) + 1), lambda i: c2[i].role = 'assistant') AS ci, list_filter(range(1, len(r2) + 1), lambda i: r2[i].role = 'assistant') AS ri FROM s)
SELECT conv_id, m::BIGINT AS n_shared, array_to_string(sp, '') AS prompt, array_to_string(sc, '') AS chosen, array_to_string(sr, '') AS rejected,
  array_to_string(list_transform(ci, lambda i: (length(array_to_string(sc[1:i-1], '')) + 13 + length(c2[i].role))::VARCHAR || ':' || (length(array_to_string(sc[1:i], '')) - 1)::VARCHAR), ',') AS chosen_mask,
  array_to_string(list_transform(ri, lambda i: (length(array_to_string(sr[1:i-1], '')) + 13 + length(r2[i].role))::VARCHAR || ':' || (length(array_to_string(sr[1:i], '')) - 1)::VARCHAR), ',') AS rejected_mask
FROM z"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest AS g, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d LEFT JOIN f ON g = payload_digest"""

SUBSTRING_SQL = r"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM src WHERE len(w) >= 13)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN least_doc USING (k) WHERE m < doc_id),
pos AS (SELECT rid, list(p) AS ps, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM src LEFT JOIN pos ON pos.rid = src.rid"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
st AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT qid, item_id, t, count(*)::BIGINT AS c FROM (SELECT qid, item_id, unnest(w) AS t FROM b) GROUP BY 1, 2, 3),
p AS (SELECT rid, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3, 4),
g AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t), st),
s AS (SELECT qid, item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN g USING (t), st GROUP BY 1, 2, 3, 4)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

#: CRC-32 by its table of 256 rests, over the bytes of each different feature.
RESAMPLING_SQL = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
df AS (SELECT rid, array_to_string(w[i:i+n-1], ' ') AS f FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT unnest([1, 2, 3]) AS n))),
bf AS (SELECT array_to_string(w[i:i+n-1], ' ') AS f FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT {_TERMS} AS w FROM benchmark), (SELECT unnest([1, 2, 3]) AS n))),
fs AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
fb AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM fs),
fk AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM fb, tab),
s AS (SELECT k, count(*)::BIGINT AS s FROM df JOIN fk USING (f) GROUP BY k),
t AS (SELECT k, count(*)::BIGINT AS t FROM bf JOIN fk USING (f) GROUP BY k),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS big_t),
g AS (SELECT s.k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS g FROM s LEFT JOIN t ON t.k = s.k, sums),
wt AS (SELECT rid, count(*)::BIGINT AS n_features, sum(g)::BIGINT AS weight FROM df JOIN fk USING (f) JOIN g USING (k) GROUP BY rid),
x AS (SELECT dw.rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM dw LEFT JOIN wt ON wt.rid = dw.rid),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_words >= 20 AND r <= 5 * (SELECT count(*) FROM y WHERE n_words >= 20) // 100 THEN r END::BIGINT AS rank FROM z"""

LINE_SQL = """
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents),
l AS (SELECT rid, i, ln[i] AS x, translate(trim(ln[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, ln, unnest(range(1, len(ln) + 1)) AS i FROM src)),
common AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10),
m AS (SELECT rid, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
  FROM l LEFT JOIN common ON common.k = l.k GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM src JOIN m USING (rid)"""
