"""op7: base counts and the line-first verdict for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.common import documents
from lakemill.llm.quality_rules import BOILERPLATE, clean_lines

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars"]

ORACLE = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS w FROM d, unnest(range(1, len(words) - 6)) u(i)
), again AS (
  SELECT doc_id, w FROM windows GROUP BY ALL HAVING COUNT(*) > 1
), repeated AS (
  SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM windows JOIN again USING (doc_id, w), range(8) r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, length(line) AS n_chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words,
         len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x IN ('|', '>', '»', '·', '•'))) AS n_separators,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS n_marks
  FROM (SELECT doc_id, unnest(lines) AS line FROM d)
), judged AS (
  SELECT doc_id, n_chars,
         n_marks * 10 > n_chars
         OR (n_words >= 5 AND regexp_matches(line, '^[^\p{Ll}]*$') AND regexp_matches(line, '\p{Lu}{2}'))
         OR (n_separators >= 3 AND n_separators * 5 >= n_words)
         OR (n_words >= 12 AND NOT regexp_matches(line, '[.!?:;,…"''”’»)\]]'))
         OR regexp_matches(line, '(?i)BOILERPLATE') AS fails
  FROM lines
), sums AS (
  SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (fails) AS n_failed_lines, SUM(n_chars) AS line_chars, COALESCE(SUM(n_chars) FILTER (fails), 0) AS lost_chars
  FROM judged GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, COALESCE(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(d.lines) - len(list_distinct(d.lines)))::BIGINT AS n_dup_lines, COALESCE(repeated.n, 0)::BIGINT AS n_repeat_words,
         COALESCE(n_lines, 0)::BIGINT AS n_lines, COALESCE(n_failed_lines, 0)::BIGINT AS n_failed_lines,
         COALESCE(lost_chars, 0)::BIGINT AS lost_chars, COALESCE(line_chars, 0)::BIGINT AS line_chars
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN sums USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.5 * line_chars AS kept, n_lines, n_failed_lines, lost_chars
FROM counts
""".replace("BOILERPLATE", "|".join(BOILERPLATE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir, "doc_id", "text")).select(COLUMNS)
