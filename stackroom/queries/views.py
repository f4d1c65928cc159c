"""An archive's entities as views of the input tables, for Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators.catalog import STATUSES
from stackroom.session import table

_STATUS_LIST = ", ".join(f"'{s}'" for s in STATUSES)

#: documents with what an archive knows of them
DOCS = f"""docs AS (SELECT doc_id, source AS collection, lang, n_chars, text,
  'Doc-' || doc_id || '.' || (['txt', 'MD', 'html', 'csv'])[doc_id % 4 + 1] AS filename,
  source || '/Doc-' || doc_id || '.' || (['txt', 'MD', 'html', 'csv'])[doc_id % 4 + 1] AS path,
  (['text/plain', 'text/markdown', 'text/html', 'text/csv'])[doc_id % 4 + 1] AS media_type,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'Title 100%_' || doc_id END AS title,
  'Author ' || (doc_id % 17) AS author,
  ([{_STATUS_LIST}])[doc_id % 13 + 1] AS status,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 61 SECOND AS created_at,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'v' || (doc_id % 3) END AS fingerprint FROM documents)"""

#: lines of documents as citable units
UNITS = """units AS (SELECT doc_id, generate_subscripts(l, 1)::BIGINT - 1 AS ordinal, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

#: units with how they were read
EXTRACTED = """extracted AS (SELECT *, CASE WHEN ordinal % 11 = 7 THEN NULL WHEN ordinal % 3 = 0 THEN 'OCR' ELSE 'TEXT' END AS method,
  CASE WHEN ordinal % 11 = 7 THEN 'FAILED' ELSE 'DONE' END AS state,
  CASE WHEN ordinal % 11 = 7 THEN 'E' || (doc_id % 3) END AS code FROM units)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % len(v) + 1).cast("int"))
    name = F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit("."), pick("txt", "MD", "html", "csv"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("collection"), "lang", "n_chars", "text", name.alias("filename"), F.concat("source", F.lit("/"), name).alias("path"),
        pick("text/plain", "text/markdown", "text/html", "text/csv").alias("media_type"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Title 100%_"), F.col("doc_id").cast("string"))).alias("title"),
        F.concat(F.lit("Author "), (F.col("doc_id") % 17).cast("string")).alias("author"), pick(*STATUSES).alias("status"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 61).alias("created_at"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"))).alias("fingerprint"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n"))).select("doc_id", F.col("pos").cast("long").alias("ordinal"), F.col("col").alias("text"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("ordinal") % 11 == 7
    return units(spark, sf_dir).withColumns({
        "method": F.when(~failed, F.when(F.col("ordinal") % 3 == 0, "OCR").otherwise("TEXT")), "state": F.when(failed, "FAILED").otherwise("DONE"), "code": F.when(failed, F.concat(F.lit("E"), (F.col("doc_id") % 3).cast("string"))),
    })
