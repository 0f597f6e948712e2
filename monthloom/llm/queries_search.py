"""Registered query of the lexical search and its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from monthloom.llm.files import table
from monthloom.llm.lexical_search import search


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
terms AS (SELECT row_id, doc_id, {_TERMS} AS term FROM d),
items AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)
          GROUP BY ALL),
tf AS (SELECT row_id, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
len AS (SELECT row_id, count(*) AS n FROM terms GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE)))
                        AS BIGINT) AS w
      FROM tf, total GROUP BY term, docs),
m AS (SELECT row_id, 75 + ((25 * n * docs) // words) AS m FROM len, total),
scored AS (
  SELECT item_id, row_id, doc_id,
         CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
             AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""}
