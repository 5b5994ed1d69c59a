"""Queries that scan whole texts and audit their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farspark.llm import divergence, secrets
from farspark.llm.registry import query
from farspark.llm.tables import table


def _secrets_sql() -> str:
    """Places of matches from the lengths of what lies between them; SQL finds each rule by itself."""
    branches = []
    for number, rule in enumerate(secrets.RULES):
        pattern = f"(?:{rule.head.replace('(', '(?:')})({rule.body.replace('(', '(?:')})".replace("'", "''")
        branches.append(
            f"SELECT row, {number} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_split_to_array(t, '{pattern}') AS p, "
            f"regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', 1) AS b FROM d")
    joined = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({" UNION ALL ".join(branches)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM h WHERE len(m) > 0),
s AS (SELECT row, k, kind, least, len(b[i]) AS n, len(m[i]) AS size,
      CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS a
      FROM i),
f AS (SELECT *, a + size AS z FROM s WHERE n >= least),
g AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      {joined} FILTER (k < {len(secrets.BASE)}) AS base, {joined} AS spans FROM f GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row = g.row"""


@query("op11_secret_scans", _secrets_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(secrets.BASE)),
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, v.v FROM groups g JOIN kept k USING (lang) JOIN v USING (lang)
         LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (CAST(n AS HUGEINT) + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
      sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lt FROM grid),
q AS (SELECT *, 1 + (1000000000 * (CAST(ln AS HUGEINT) + 5)) // (lt + 5 * v) AS q FROM p),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM q a JOIN q b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM q WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op13_source_divergence_audit", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
