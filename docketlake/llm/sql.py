"""SQL of the queries on repeats and near-duplicates, by plain definitions."""

OP3_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w)),
d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + j AS i FROM (SELECT r, i, unnest(generate_series(0, 34)) AS j FROM k WHERE h IN (SELECT h FROM d))),
t AS (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM w),
g AS (SELECT t.r, count(*) FILTER (c.i IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY t.i) FILTER (c.i IS NULL) AS kept FROM t LEFT JOIN c ON t.r = c.r AND t.i = c.i GROUP BY t.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (r)
"""

OP7_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT r, i, md5(substr(x, 2 * i - 1, 800)) AS h FROM (SELECT r, x, unnest(generate_series(1, length(x) // 2 - 399)) AS i FROM w)),
d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
b AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before_i FROM k WHERE h IN (SELECT h FROM d)),
s AS (SELECT r, i, sum(CASE WHEN before_i IS NULL OR i > before_i + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM b),
m AS (SELECT r, span, min(i) AS lo, max(i) + 399 AS hi FROM s GROUP BY r, span),
p AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS last_hi, max(hi) OVER (PARTITION BY r) AS end_hi FROM m),
g AS (SELECT p.r, count(*) AS n_spans, sum(hi - lo + 1) AS n_removed, string_agg(substr(x, 2 * last_hi + 1, 2 * (lo - last_hi - 1)), '' ORDER BY lo) || any_value(substr(x, 2 * end_hi + 1)) AS kept FROM p JOIN w USING (r) GROUP BY p.r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM w LEFT JOIN g USING (r)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS k, count(*) AS shared FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * shared >= 80 * (n + k - shared)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT doc_id AS node, doc_id AS seen FROM s UNION SELECT c.node, u.b FROM c JOIN u ON c.seen = u.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m.component_id, doc_id = m.component_id AS kept FROM s JOIN (SELECT node, min(seen) AS component_id FROM c GROUP BY node) AS m ON s.doc_id = m.node
"""

#: The table of the reversed CRC-32 polynomial, made by its rule.
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"


def crc32(text: str) -> str:
    """SQL of the CRC-32 of a string's bytes; reads crc_table.t."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
