"""SQL, as DuckDB runs it, for the queries that SQL can express."""

WARC = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, n, min(page_id) AS first FROM d GROUP BY s, n),
b AS (SELECT d.*, f.first, from_hex(d.s)::BIT::VARCHAR AS bits FROM d JOIN f USING (s, n))
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * (substr(bits, (5 * i + 1)::BIGINT, 1) = '1')::INT + 8 * (substr(bits, (5 * i + 2)::BIGINT, 1) = '1')::INT
    + 4 * (substr(bits, (5 * i + 3)::BIGINT, 1) = '1')::INT + 2 * (substr(bits, (5 * i + 4)::BIGINT, 1) = '1')::INT
    + (substr(bits, (5 * i + 5)::BIGINT, 1) = '1')::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

QUALITY = r"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM t),
v AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n FROM v WHERE e IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '!')) AS bangs, len(regexp_extract_all(t, '[A-Z]')) AS capitals,
  len(regexp_extract_all(t, '[A-Za-z]')) AS letters, len(ls) AS n_lines FROM t JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  least(1000, greatest(1000 * n_symbols // greatest(n_words, 1), 1000 * bangs // greatest(n_words, 1), 1000 * n_repeat_words // greatest(n_words, 1),
    1000 * n_dup_lines // greatest(n_lines, 1), 1000 * capitals // greatest(letters, 1)))::INTEGER AS score FROM f),
g AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT lang, score, good FROM s JOIN g USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL),
k AS (SELECT lang, cutoff::INTEGER AS cutoff, count(*) FILTER (good > 0) AS n_good, count(*) FILTER (good <= 0) AS n_bad, count(*) FILTER (good > 0 AND score >= cutoff) AS n_false,
  count(*) FILTER (good <= 0 AND score >= cutoff) AS n_caught FROM h, range(50, 1001, 50) AS x(cutoff) GROUP BY ALL),
p AS (SELECT *, CASE WHEN n_false > 0.05 * n_good THEN 1.0 ELSE list_sum(list_transform(range(0, n_false + 1),
  lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.05::DOUBLE) + (n_good - i) * ln(0.95::DOUBLE)))) END AS p_value,
  (SELECT count(*) FROM k) AS tests FROM k),
q AS (SELECT lang, cutoff FROM p WHERE n_caught > 0 AND p_value * tests <= 0.05
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(n_caught::DOUBLE / n_bad - n_false::DOUBLE / n_good, 9) DESC, cutoff DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score < cutoff, true) AS kept, score, cutoff
FROM s LEFT JOIN q USING (lang)
"""

SUBSTRING = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS h FROM i JOIN t USING (doc_id)),
m AS (SELECT h, min(doc_id) AS m FROM w GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (h) WHERE m < doc_id),
k AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ps, x)), lambda x: ws[x]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS near FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.near = l.a),
c AS (SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLE = {"op1_warc": WARC, "op2_quality_rules": QUALITY, "op6_substring_dedup": SUBSTRING, "op7_embedding_near_dedup": EMBEDDINGS}
