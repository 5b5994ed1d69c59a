"""The query over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farspark.llm import chats
from farspark.llm.registry import query
from farspark.llm.tables import table

CHATS_SQL = """
WITH t AS (
  SELECT conv_id, turn, '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS place
  FROM conversations),
p AS (
  SELECT conv_id, place, list(line) OVER (PARTITION BY conv_id ORDER BY place) AS lines,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT lines, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n GROUP BY lines, n)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, n_copies, list_aggregate(lines, 'string_agg', '') AS text FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = w.n AND p.lines = w.lines)"""


@query("op4_chat_formatting", CHATS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))
