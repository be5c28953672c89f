"""op12: damaged conversations, the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, prepare
from .repair import conversation_key, repair_conversations, whole_conversations
from .sql import CRC_TABLE, crc32


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of conversation and turn decides; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("code") == 3).cast("int"))))
    return twice.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    prepare(spark)
    return repaired_digests(dealt(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """The contract's columns for each conv_id, those without turns after the damage included."""
    found = whole_conversations(cut(repair_conversations(damaged(conversations))))
    ids = conversations.select("conv_id").distinct().withColumn("conv_key", conversation_key(F.col("conv_id")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "conv_key", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations, crc_table),
d AS (SELECT id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(generate_series(0, CASE WHEN code = 3 THEN 1 ELSE 0 END)) AS copy FROM o WHERE code <> 0),
p AS (SELECT *, substr(role, 1, 1) AS c, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off FROM d),
t AS MATERIALIZED (SELECT id, turn, role, text, c, i, blank, again AND NOT blank AS again, cut_off AND NOT again AND NOT blank AS cut_off, blank OR again AS gone,
        lag(c) OVER (PARTITION BY id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS wrong, max(i) OVER (PARTITION BY id) AS n FROM p),
e AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again,
        count(*) FILTER (cut_off) AS cut_off, count(*) FILTER (wrong) AS wrong, count(*) AS n FROM t GROUP BY id),
b AS (
  SELECT id, n AS i, 0::BIGINT AS f0, 4::BIGINT AS f1, 2::BIGINT AS f2, 0::BIGINT AS f3 FROM e
  UNION ALL
  SELECT id, i, least(g0, 2 + least(g2, 2 + g3)), least(g1, 2 + least(g2, 2 + g3)), least(g2, 2 + g3), least(g3, 2 + g2) FROM (
    SELECT b.id, b.i - 1 AS i,
      least(3 + f0, CASE WHEN gone THEN 999999999 ELSE q + 2 + f2 END, CASE WHEN gone THEN 999999999 WHEN c = 's' THEN q + f1 WHEN c = 'u' THEN q + f2 ELSE 999999999 END) AS g0,
      least(3 + f1, CASE WHEN gone THEN 999999999 ELSE q + 2 + f2 END, CASE WHEN NOT gone AND c = 'u' THEN q + f2 ELSE 999999999 END) AS g1,
      least(3 + f2, CASE WHEN gone THEN 999999999 ELSE q + 2 + f3 END, CASE WHEN NOT gone AND c = 'a' THEN q + f3 ELSE 999999999 END) AS g2,
      least(3 + f3, CASE WHEN gone THEN 999999999 ELSE q + 2 + f2 END, CASE WHEN NOT gone AND c = 'u' THEN q + f2 ELSE 999999999 END) AS g3
    FROM b JOIN (SELECT id AS t_id, i AS t_i, c, gone, CASE WHEN cut_off THEN 1 ELSE 0 END AS q FROM t) ON id IS NOT DISTINCT FROM t_id AND b.i = t_i)),
m AS MATERIALIZED (SELECT u.id, u.i, [u.f0, u.f1, u.f2, u.f3] AS f, [x.f0, x.f1, x.f2, x.f3] AS g, t.c, t.role, t.text, t.gone, CASE WHEN t.cut_off THEN 1 ELSE 0 END AS q
  FROM b AS u LEFT JOIN b AS x ON u.id IS NOT DISTINCT FROM x.id AND x.i = u.i + 1 LEFT JOIN t ON u.id IS NOT DISTINCT FROM t.id AND t.i = u.i + 1),
w AS (
  SELECT id, 0::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS lines, true AS going FROM e
  UNION ALL
  SELECT id, CASE WHEN x IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
    CASE WHEN x IN ('I', 'R') THEN after_s WHEN x = 'K' THEN keep_s ELSE s END, audit || x,
    CASE x WHEN 'I' THEN list_append(lines, next_role || ':') WHEN 'R' THEN list_append(lines, next_role || ':' || text) WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE lines END, x <> ''
  FROM (SELECT *, CASE WHEN g IS NOT NULL AND f[s] = 3 + g[s] THEN 'D' WHEN f[s] = 2 + f[after_s] THEN 'I'
      WHEN NOT gone AND keep_s IS NOT NULL AND f[s] = q + g[keep_s] THEN 'K' WHEN NOT gone AND f[s] = q + 2 + g[after_s] THEN 'R' ELSE '' END AS x
    FROM (SELECT w.id, w.i, w.s, w.audit, w.lines, m.f, CASE WHEN m.c IS NULL THEN NULL ELSE m.g END AS g, m.role, m.text, m.gone, m.q, CASE w.s WHEN 3 THEN 4 ELSE 3 END AS after_s,
        CASE w.s WHEN 3 THEN 'assistant' ELSE 'user' END AS next_role,
        CASE WHEN m.c = 's' AND w.s = 1 THEN 2 WHEN m.c = 'u' AND w.s <> 3 THEN 3 WHEN m.c = 'a' AND w.s = 3 THEN 4 END AS keep_s
      FROM w JOIN m ON w.id IS NOT DISTINCT FROM m.id AND w.i = m.i WHERE w.going))),
z AS (SELECT * FROM w WHERE NOT going)
SELECT a.id AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.again, 0) AS duplicate, coalesce(e.cut_off, 0) AS truncated, coalesce(e.wrong, 0) AS illegal,
  CAST(coalesce(m.f[1], 0) AS BIGINT) AS cost, coalesce(z.audit, '') AS audit, sha256(coalesce(array_to_string(z.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT id FROM o) AS a LEFT JOIN e ON a.id IS NOT DISTINCT FROM e.id LEFT JOIN m ON a.id IS NOT DISTINCT FROM m.id AND m.i = 0 LEFT JOIN z ON a.id IS NOT DISTINCT FROM z.id
"""
