"""Registered query of the web archives."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from monthloom.llm.files import table
from monthloom.llm.warc import Archive


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = Archive(spark, pages)
    found = archive.look_up(pages, key="page_id")
    return archive.read(found, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
#: The digest in SQL: each 5 hexadecimal digits of the SHA-1 are four signs of base 32.
ORACLES = {"op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p
), k AS (
  SELECT hex, payload_bytes, max(page_id) AS keeper, count(*) AS n FROM d GROUP BY ALL
), v AS (
  SELECT hex, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT)
         AS q FROM (SELECT DISTINCT hex FROM d)
), b AS (
  SELECT hex, array_to_string(list_transform(q, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::INT + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::INT + 1, 1)), '') AS payload_digest FROM v
)
SELECT d.page_id, d.payload_bytes, b.payload_digest,
       CASE WHEN k.n > 1 AND d.page_id IS DISTINCT FROM k.keeper AND k.keeper IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.n > 1 AND d.page_id IS DISTINCT FROM k.keeper THEN k.keeper END AS refers_to
FROM d JOIN k USING (hex, payload_bytes) JOIN b USING (hex)
"""}
