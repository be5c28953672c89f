"""op11: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .phrases import collocations


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first 2000 phrases."""
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP11_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, size, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
      FROM w, range(1, 6) AS x(size) WHERE len(w) >= size),
f AS MATERIALIZED (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM s GROUP BY lang, size, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
x AS (SELECT lang, size - 1 AS size, phrase, max(a) AS longer FROM
  (SELECT lang, size, a, unnest([array_to_string(w[1 : size - 1], ' '), array_to_string(w[2 : size], ' ')]) AS phrase FROM c WHERE size > 2) GROUP BY ALL),
k AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.size = c.size AND x.phrase = c.phrase AND x.longer >= c.a)),
g AS (SELECT k.lang, k.phrase, k.a, u.a AS l, v.a AS r, n, k.k, (1000 * k.a * n) // (u.a * v.a) AS score FROM k JOIN n USING (lang)
  JOIN f AS u ON u.lang = k.lang AND u.size = k.k AND u.phrase = array_to_string(k.w[1 : k.k], ' ')
  JOIN f AS v ON v.lang = k.lang AND v.size = k.size - k.k AND v.phrase = array_to_string(k.w[k.k + 1 : k.size], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
