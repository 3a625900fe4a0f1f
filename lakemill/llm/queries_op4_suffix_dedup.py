"""op4: bytes of every document that repeat an earlier 100-byte string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import documents
from lakemill.llm.suffix_dedup import remove_repeats

#: Every 100-byte window as hexadecimal text; windows of which an equal one comes before; their union, and what it leaves.
ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i AS s, substr(h, 2 * i + 1, 200) AS x FROM d, unnest(range(greatest(length(h) // 2 - 99, 0))) u(i)
), firsts AS (
  SELECT x, MIN(struct_pack(doc_id := doc_id, s := s)) AS f FROM windows GROUP BY x HAVING COUNT(*) > 1
), later AS (
  SELECT doc_id, s FROM windows JOIN firsts USING (x) WHERE struct_pack(doc_id := doc_id, s := s) <> f
), marked AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM later
), spans AS (
  SELECT doc_id, MIN(s) AS a, MAX(s) + 100 AS b FROM (SELECT *, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked) GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, a, b, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), cut AS (
  SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(ANY_VALUE(h), 2 * MAX(b) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(COALESCE(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), length=100)
