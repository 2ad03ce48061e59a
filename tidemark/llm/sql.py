"""SQL (DuckDB) for the queries that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"

SQL = {
    "op1_chat_format": r"""
WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</turn>'))
 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('### ') + length(role) + length(': ') + n + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op2_decontaminate": f"""
WITH i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ig JOIN dg USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n - 1e-9""",
    "op4_warc_dictionary": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM f""",
    "op9_quality_ledger": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
r AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS j FROM r WHERE c > 1) GROUP BY 1),
l AS (SELECT d.doc_id, w, t, array_to_string(w, '') AS x, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN v USING (doc_id)),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(x) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS BIGINT) AS n_stutters FROM l),
b AS (SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > 3 * n_words AS BIGINT) + 8 * CAST(10 * n_dup_lines > 6 * n_lines AS BIGINT)
 + 16 * CAST(2 * n_upper > word_chars AS BIGINT) + 32 * CAST(word_chars > 14 * n_words AS BIGINT) + 64 * CAST(10 * n_stutters > 4 * n_words AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, n_lines, n_upper, n_stutters, failed_bits FROM b""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS j FROM f WHERE first < doc_id),
x AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY 1),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
y AS (SELECT doc_id, string_agg(w[j], ' ' ORDER BY j) AS kept FROM p ANTI JOIN c USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op11_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_periodic_runs": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, b:
 list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)) AS u FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(u, 4294967295) AS h, xor(u, 4294967295) // 10 AS g FROM d),
a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM h),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM a),
k AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM t),
e AS (SELECT doc_id, k.i, l.i - k.i AS p FROM k JOIN k l USING (doc_id, x) WHERE l.i > k.i AND 3 * (l.i - k.i) <= k.n),
f AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, p, min(i) AS s, max(i) + p + 1 AS e FROM f GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
r AS (SELECT doc_id, s, e - s AS n, min(p) AS p FROM s GROUP BY doc_id, s, e),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS told FROM r GROUP BY 1),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n / p DESC, s, p) = 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + n)) AS i FROM r),
y AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM k ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.p AS period, 1000 * b.n // b.p AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op13_prefix_tree_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
}
