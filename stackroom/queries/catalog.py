"""Listings, joins, aggregates, orders and set operations (filters FLT, projections PRJ, joins JN, aggregates AG, windows WN, sorts SL, sets ST, sinks SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackroom.functions.text import extension
from stackroom.operators import catalog as C
from stackroom.queries.views import DOCS, EXTRACTED, UNITS, docs, extracted, units
from stackroom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _n(condition):
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


# filters


@query(f"""WITH {DOCS} SELECT doc_id, filename FROM docs WHERE collection <> 'src3' AND media_type IN ('text/plain', 'text/html')
  AND (filename ILIKE '%doc-1%' OR path ILIKE '%doc-1%') AND (coalesce(title ILIKE '%100!%!_%' ESCAPE '!', FALSE) OR author ILIKE '%100!%!_%' ESCAPE '!')
  AND created_at >= TIMESTAMP '2024-01-01 00:00:00' AND created_at < TIMESTAMP '2024-03-01 00:00:00' AND status IN ('COMPLETE', 'FAILED', 'OCR', 'QUEUED', 'INDEXING')""")
def doc_criteria_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = C.Filters(None, ("text/plain", "text/html"), "doc-1", "100%_", "2024-01-01", "2024-02-29", ("COMPLETE", "FAILED", "OCR", "QUEUED", "INDEXING"))
    return C.find_documents(docs(spark, sf).filter("collection <> 'src3'"), f).select("doc_id", "filename")


@query(f"WITH {DOCS}, {UNITS}, {EXTRACTED} SELECT doc_id, collection FROM docs d WHERE lang = 'en' AND EXISTS (SELECT 1 FROM extracted e WHERE e.doc_id = d.doc_id AND method = 'OCR' AND ordinal > 2)")
def ocr_only_semi(spark: SparkSession, sf: str) -> DataFrame:
    ocr = extracted(spark, sf).filter((F.col("method") == "OCR") & (F.col("ordinal") > 2))
    return C.find_documents(docs(spark, sf).filter(F.col("lang") == "en"), C.Filters(ocr_only=True), ocr).select("doc_id", "collection")


@query("SELECT d.doc_id, d.lang FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.in_scope(table(spark, sf, "documents"), table(spark, sf, "labels").filter("quality = 1")).select("doc_id", "lang")


_PATTERNS = ["*.html", "src1?/", "!src12/", "**/doc-2*", "src3/doc-1?.*", "!*.md", "/src5/Doc-1*.txt"]


@query(f"""WITH {DOCS}, p AS (SELECT doc_id, path, lower(path) AS q FROM docs), v AS (SELECT doc_id, path,
  CASE WHEN regexp_full_match(q, 'src5/doc-1[^/]*\\.txt') THEN TRUE WHEN regexp_full_match(q, '(.*/)?[^/]*\\.md') THEN FALSE WHEN regexp_full_match(q, 'src3/doc-1[^/]\\.[^/]*') THEN TRUE
   WHEN regexp_full_match(q, '(.*/)?doc-2[^/]*') THEN TRUE WHEN regexp_full_match(q, '(.*/)?[^/]*\\.html') THEN TRUE ELSE FALSE END AS own,
  CASE WHEN regexp_full_match(split_part(q, '/', 1), 'src12') THEN FALSE WHEN regexp_full_match(split_part(q, '/', 1), 'src1[^/]') THEN TRUE ELSE FALSE END AS parent FROM p)
  SELECT doc_id, path, own OR parent AS ignored FROM v""")
def ignore_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", "path", C.ignored(F.col("path"), F.lit(False), _PATTERNS).alias("ignored"))


@query(f"WITH {DOCS} SELECT doc_id, lower(regexp_extract(filename, '^.+\\.([^.]+)$', 1)) AS ext FROM docs WHERE lower(regexp_extract(filename, '^.+\\.([^.]+)$', 1)) IN ('md', 'csv')")
def extension_filter(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).filter(C.admitted(F.col("filename"), include=["md", "csv"])).select("doc_id", extension(F.col("filename")).alias("ext"))


@query(f"""WITH {DOCS} SELECT doc_id, filename FROM docs WHERE NOT regexp_full_match(lower(path), '(.*/)?[^/]*\\.html') AND lower(regexp_extract(filename, '^.+\\.([^.]+)$', 1)) NOT IN ('csv')
  AND media_type IN ('text/plain', 'text/markdown', 'text/html', 'text/csv')""")
def import_admission(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    ok = ~C.ignored(F.col("path"), F.lit(False), ["*.html"]) & C.admitted(F.col("filename"), exclude=["csv"]) & F.col("media_type").isin("text/plain", "text/markdown", "text/html", "text/csv")
    return d.filter(ok).select("doc_id", "filename")


@query(f"WITH {DOCS} SELECT a.doc_id FROM docs a JOIN docs b ON a.doc_id = b.doc_id + 1 WHERE a.fingerprint IS DISTINCT FROM b.fingerprint")
def null_safe_compare(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("fingerprint").alias("other"))
    return d.join(before, "doc_id").filter(~F.col("fingerprint").eqNullSafe(F.col("other"))).select("doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_field_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter(F.get_json_object("props", "$.k") == "42").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7))")
def visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    mine = table(spark, sf, "customer").filter(F.col("c_nationkey").isin(3, 7)).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"WITH {DOCS} SELECT doc_id, status, row_number() OVER (ORDER BY created_at, doc_id) AS place FROM docs WHERE status IN ('COMPLETE_WITH_WARNINGS', 'NEEDS_TOOL', 'FAILED') ORDER BY created_at, doc_id")
def retry_eligible(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).filter(F.col("status").isin(*C.RETRY_STATUSES)).select("doc_id", "status", "created_at")
    return C.places(rows, "created_at", "doc_id").select("doc_id", "status", "place").orderBy("place")


@query("""SELECT event_id, CASE WHEN lower(trim(name)) IN ('password', 'token', 'authorization', 'api_key', 'apikey', 'secret', 'cookie') THEN '[redacted]' ELSE v END AS shown
  FROM (SELECT event_id, CASE event_type WHEN 'error' THEN ' Token ' WHEN 'click' THEN 'API_KEY' ELSE event_type END AS name, CAST(user_id AS VARCHAR) AS v FROM events)""")
def redact_fields(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", " Token ").when(F.col("event_type") == "click", "API_KEY").otherwise(F.col("event_type"))
    fields = C.redact(F.create_map(name, F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", F.map_values(fields)[0].alias("shown"))


# projections


@query("""SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'Page ' || a WHEN 1 THEN 'Slide ' || a WHEN 2 THEN CASE WHEN a = b THEN 'Line ' || a ELSE 'Lines ' || a || '–' || b END
  WHEN 3 THEN 'Sheet rows ' || a || '–' || b WHEN 4 THEN coalesce(h, 'Document') ELSE 'Image' END AS label FROM (SELECT *, l_orderkey % 6 AS k, l_linenumber AS a, l_linenumber + l_orderkey % 2 AS b,
  CASE WHEN l_partkey % 2 = 0 THEN 'Heading ' || l_suppkey END AS h FROM lineitem)""")
def location_labels(spark: SparkSession, sf: str) -> DataFrame:
    from stackroom.functions.text import describe_location

    kind = F.element_at(F.array(*map(F.lit, ["pdf_page", "slide", "text_lines", "spreadsheet_range", "html_section", "image"])), (F.col("l_orderkey") % 6 + 1).cast("int"))
    heading = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Heading "), F.col("l_suppkey").cast("string")))
    name = F.when(kind == "spreadsheet_range", F.lit("Sheet")).otherwise(heading)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", describe_location(kind, F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_orderkey") % 2, name).alias("label"))


@query(f"WITH {DOCS} SELECT doc_id, coalesce(nullif(trim(title), ''), nullif(trim(filename), ''), CAST(doc_id AS VARCHAR)) AS display, CASE WHEN status IN ('NEEDS_TOOL', 'OCR') THEN 'NEEDS_TOOL' ELSE 'FAILED' END AS failure FROM docs")
def display_title(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return docs(spark, sf).select("doc_id", F.coalesce(some(F.col("title")), some(F.col("filename")), F.col("doc_id").cast("string")).alias("display"), F.when(F.col("status").isin("NEEDS_TOOL", "OCR"), "NEEDS_TOOL").otherwise("FAILED").alias("failure"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Reading' WHEN 'P' THEN 'Indexing' ELSE 'Done' END || ', ' || CASE WHEN n = 1 THEN '1 file' ELSE n || ' files' END AS label
  FROM (SELECT *, o_custkey % 3 AS n FROM orders)""")
def progress_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_custkey") % 3
    stage = F.when(F.col("o_orderstatus") == "O", "Reading").when(F.col("o_orderstatus") == "P", "Indexing").otherwise("Done")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(stage, F.lit(", "), F.when(n == 1, "1 file").otherwise(F.concat(n.cast("string"), F.lit(" files")))).alias("label"))


# joins


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def inner_equi_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return o.join(c, "o_custkey").join(n, "c_nationkey").select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def collections_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(counted, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("SELECT o_orderkey, count(*) AS n_all, count(l_linenumber) AS n_first FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber < 4 GROUP BY 1")
def left_join_residual(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter("l_linenumber < 4").withColumnRenamed("l_orderkey", "o_orderkey")
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("*").alias("n_all"), F.count("l_linenumber").alias("n_first"))


@query(f"WITH {UNITS}, {EXTRACTED} SELECT u.doc_id, u.ordinal, e.method FROM units u LEFT JOIN extracted e ON u.doc_id = e.doc_id AND u.ordinal = e.ordinal AND e.state = 'DONE'")
def composite_left_join(spark: SparkSession, sf: str) -> DataFrame:
    done = extracted(spark, sf).filter("state = 'DONE'").select("doc_id", "ordinal", "method")
    return units(spark, sf).select("doc_id", "ordinal").join(done, ["doc_id", "ordinal"], "left")


@query("""SELECT o_custkey, p.only_priority FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN
  (SELECT o_custkey AS k, min(o_orderpriority) AS only_priority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1) p ON o_custkey = k""")
def unique_owner_having(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    grouped = o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("low"), F.max("o_orderpriority").alias("high"))
    return grouped.select("o_custkey", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only_priority"))


@query("""SELECT e.event_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = coalesce(CASE WHEN e.user_id % 2 = 0 THEN e.user_id END,
  (SELECT min(o_custkey) FROM orders WHERE o_orderkey = e.event_id)) WHERE e.event_type = 'purchase'""")
def coalesced_key_join(spark: SparkSession, sf: str) -> DataFrame:
    owner = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("event_id")).agg(F.min("o_custkey").alias("owner"))
    e = table(spark, sf, "events").filter("event_type = 'purchase'").join(owner, "event_id", "left")
    key = F.coalesce(F.when(F.col("user_id") % 2 == 0, F.col("user_id")), F.col("owner"))
    return e.withColumn("c_custkey", key).join(table(spark, sf, "customer"), "c_custkey").select("event_id", "c_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_exists(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_join_in(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(used, "p_partkey", "left_semi").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {DOCS}, active AS (SELECT doc_id, fingerprint AS active FROM docs WHERE doc_id % 2 = 0), rows_ AS (SELECT doc_id, 'v' || (doc_id % 4) AS revision FROM docs)
  SELECT r.doc_id FROM rows_ r LEFT JOIN active a ON r.doc_id = a.doc_id WHERE a.active IS DISTINCT FROM r.revision""")
def unpublished_anti(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    active = d.filter("doc_id % 2 = 0").select("doc_id", F.col("fingerprint").alias("active"))
    rows = d.select("doc_id", F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string")).alias("revision"))
    return rows.join(active, "doc_id", "left").filter(~F.col("active").eqNullSafe(F.col("revision"))).select("doc_id")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount >= 0.1 AND l_quantity > 49)")
def exists_or_condition(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "lineitem").filter("l_discount >= 0.1 AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("found")).distinct()
    return table(spark, sf, "supplier").join(marked, "s_suppkey", "left").filter("s_acctbal < 0 OR found").select("s_suppkey")


@query("SELECT l_orderkey, l_linenumber AS first_line, min(l_partkey) AS part FROM lineitem l WHERE l_linenumber = (SELECT min(l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey) GROUP BY 1, 2")
def first_unit_per_document(spark: SparkSession, sf: str) -> DataFrame:
    least = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("m"))
    return least.select("l_orderkey", F.col("m.l_linenumber").alias("first_line"), F.col("m.l_partkey").alias("part"))


@query("""SELECT conv_id, (SELECT text FROM conversations u WHERE u.conv_id = c.conv_id AND role = 'user' ORDER BY turn LIMIT 1) AS first_question,
  (SELECT text FROM conversations a WHERE a.conv_id = c.conv_id AND role = 'assistant' ORDER BY turn DESC LIMIT 1) AS last_answer FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def ask_history_first_last(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda who: F.when(F.col("role") == who, F.col("turn"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", said("user")).alias("first_question"), F.max_by("text", said("assistant")).alias("last_answer"))


@query(f"WITH {DOCS}, hits AS (SELECT doc_id * 3 % 1500 AS doc_id, doc_id AS hit FROM documents) SELECT hit, d.doc_id FROM hits h JOIN docs d ON h.doc_id = d.doc_id WHERE d.collection <> 'src2' AND d.status <> 'FAILED'")
def live_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select((F.col("doc_id") * 3 % 1500).alias("doc_id"), F.col("doc_id").alias("hit"))
    return hits.join(docs(spark, sf).filter("collection <> 'src2' AND status <> 'FAILED'").select("doc_id"), "doc_id").select("hit", "doc_id")


@query(f"WITH {UNITS} SELECT doc_id, ordinal, lag(ordinal) OVER w AS previous, lead(ordinal) OVER w AS next FROM units WHERE ordinal % 5 <> 4 WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)")
def neighbour_units(spark: SparkSession, sf: str) -> DataFrame:
    return C.neighbours(units(spark, sf).filter("ordinal % 5 <> 4").select("doc_id", "ordinal"), "doc_id", "ordinal")


@query(f"WITH {UNITS} SELECT doc_id, ordinal, string_agg(ordinal, ',' ORDER BY ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM units")
def adjacent_units(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(-2, 2)
    return units(spark, sf).select("doc_id", "ordinal", F.concat_ws(",", F.collect_list(F.col("ordinal").cast("string")).over(w)).alias("around"))


@query("""SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_suppkey % 5 = o.o_custkey % 5
  WHERE p.p_brand = 'Brand#2'""")
def three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("k"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 5).alias("k"))
    return lines.join(part, "l_partkey").join(orders, ["l_orderkey", "k"]).select("l_orderkey", "l_linenumber", "p_name")


_PROGRESS = """SELECT doc_id, count(*) AS n_units, count_if(state = 'DONE') AS n_done, count_if(state = 'FAILED') AS n_failed, CASE WHEN count(method) > 0 THEN count_if(method = 'OCR') END AS n_ocr,
  min(ordinal) AS first_unit, count(DISTINCT code) AS n_codes, min(code) AS code FROM extracted GROUP BY 1"""


@query(f"WITH {DOCS}, {UNITS}, {EXTRACTED}, progress AS ({_PROGRESS}) SELECT d.doc_id, d.status, n_units, n_done, n_failed, n_ocr, first_unit, n_codes, code FROM docs d LEFT JOIN progress USING (doc_id)")
def document_progress(spark: SparkSession, sf: str) -> DataFrame:
    progress = extracted(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_units"), F.count_if(F.col("state") == "DONE").alias("n_done"), F.count_if(F.col("state") == "FAILED").alias("n_failed"),
        F.when(F.count("method") > 0, F.count_if(F.col("method") == "OCR")).alias("n_ocr"), F.min("ordinal").alias("first_unit"), F.size(F.collect_set("code")).cast("long").alias("n_codes"), F.min("code").alias("code"),
    )
    return docs(spark, sf).select("doc_id", "status").join(progress, "doc_id", "left")


# aggregates


@query(f"WITH {DOCS} SELECT collection, count(*) AS total, count_if(lang = 'en') AS n_en FROM docs GROUP BY 1")
def filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy("collection").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query(f"WITH {DOCS}, s AS (SELECT unnest([{', '.join(repr(s) for s in C.STATUSES)}]) AS status) SELECT s.status, count(d.doc_id) AS n FROM s LEFT JOIN docs d ON d.status = s.status AND d.collection = 'src0' GROUP BY 1")
def status_counts_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return C.counts_with_zeros(docs(spark, sf).filter("collection = 'src0'"), "status", C.STATUSES)


@query(f"WITH {UNITS}, {EXTRACTED} SELECT doc_id, count(*) AS n, sum(CASE WHEN state = 'DONE' THEN 1 ELSE 0 END)::BIGINT AS done, sum(CASE WHEN method = 'OCR' THEN 1 ELSE 0 END)::BIGINT AS ocr FROM extracted GROUP BY 1")
def extraction_progress(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), _n(F.col("state") == "DONE").alias("done"), _n(F.col("method") == "OCR").alias("ocr"))


@query(f"WITH {DOCS}, {UNITS}, {EXTRACTED} SELECT d.doc_id, count(e.ordinal) AS n_pages, count(e.method) AS n_read FROM docs d LEFT JOIN extracted e ON d.doc_id = e.doc_id AND e.ordinal BETWEEN 5 AND 20 GROUP BY 1")
def revision_progress(spark: SparkSession, sf: str) -> DataFrame:
    pages = extracted(spark, sf).filter("ordinal BETWEEN 5 AND 20").groupBy("doc_id").agg(F.count("ordinal").alias("p"), F.count("method").alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return docs(spark, sf).select("doc_id").join(pages, "doc_id", "left").select("doc_id", zero("p").alias("n_pages"), zero("r").alias("n_read"))


@query("SELECT user_id, count(*) AS calls, coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END), 0)::BIGINT AS cents FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.coalesce(cents, F.lit(0).cast("long")).alias("cents"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3")
def distinct_count_having(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).filter("n = 3").select("o_custkey")


@query(f"WITH {UNITS}, {EXTRACTED} SELECT DISTINCT doc_id, code FROM extracted WHERE code IS NOT NULL")
def distinct_failure_codes(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf).filter("code IS NOT NULL").select("doc_id", "code").distinct()


@query("SELECT conv_id, coalesce(max(turn), -1) + 1 AS next_turn FROM conversations GROUP BY 1")
def next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn"))


@query(f"""WITH {DOCS}, p AS (SELECT doc_id % 50 AS page_doc, doc_id AS ordinal, sha256(text) AS now, CASE WHEN doc_id % 3 = 0 THEN sha256('x') WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(text) END AS then_ FROM docs)
  SELECT page_doc AS doc_id, count_if(now = then_) AS unchanged, count_if(now <> then_) AS changed, count_if(then_ IS NULL) AS added, 0::BIGINT AS removed FROM p GROUP BY 1""")
def revision_page_changes(spark: SparkSession, sf: str) -> DataFrame:
    pages = docs(spark, sf).select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("sha"))
    parents = pages.filter("ordinal % 3 = 0 OR ordinal % 5 <> 0").withColumn("sha", F.when(F.col("ordinal") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha")))
    return C.page_changes(pages, parents)


#: Documents as pages of readings of twenty pages each: what was before, and what was decided on it.
_KINDS = """p AS (SELECT doc_id // 20 AS doc, doc_id AS unit, (doc_id % 20)::INTEGER + CASE WHEN doc_id % 19 = 0 THEN 1000000000 ELSE 0 END AS ordinal, sha256(coalesce(text, '')) AS sha, doc_id % 11 <> 0 AS approved FROM documents),
  b AS (SELECT unit, CASE WHEN unit % 3 = 0 THEN sha256('x') ELSE sha END AS before FROM p WHERE unit % 5 <> 0 AND unit % 13 <> 0),
  r AS (SELECT unit, CASE WHEN unit % 9 = 0 THEN 'other' ELSE sha END AS candidate, CASE WHEN unit % 4 = 0 THEN 'APPROVE' ELSE 'PROPOSE' END AS disposition, 1 AS seq, CASE WHEN unit % 7 = 0 THEN 'r0' ELSE 'r1' END AS baseline FROM p WHERE unit % 2 = 0
    UNION ALL SELECT unit, sha, 'PROPOSE', 2, 'r1' FROM p WHERE unit % 24 = 0),
  d AS (SELECT unit, arg_max(disposition, seq) FILTER (candidate = sha) AS fitting FROM r JOIN p USING (unit) WHERE baseline = 'r1' GROUP BY 1),
  k AS (SELECT doc, CASE WHEN NOT approved THEN 'not_published' WHEN before IS NULL THEN 'added' WHEN before = sha THEN 'unchanged' WHEN doc % 4 = 3 THEN 'restored' WHEN fitting = 'APPROVE' THEN 'automatic' WHEN d.unit IS NOT NULL THEN 'manual' ELSE 'unknown' END AS kind
    FROM p LEFT JOIN b USING (unit) LEFT JOIN d USING (unit) WHERE ordinal < 1000000000)"""


@query(f"""WITH {_KINDS} SELECT doc AS doc_id, count_if(kind = 'unchanged') AS unchanged, count_if(kind = 'added') AS added, count_if(kind = 'automatic') AS automatic, count_if(kind = 'manual') AS manual, count_if(kind = 'unknown') AS unknown, count_if(kind = 'restored') AS restored,
  count_if(kind = 'not_published') AS not_published FROM k GROUP BY 1""")
def page_change_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each page between a revision and the one before: who changed it is read from the decisions taken against that one."""
    unit, text = F.col("unit_id"), F.coalesce("text", F.lit(""))
    every = lambda n: unit % n == 0
    pages = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("doc_id"), F.col("doc_id").alias("unit_id"), F.sha2(text, 256).alias("sha"))
    pages = pages.withColumns({"ordinal": (unit % 20 + F.when(every(19), 1_000_000_000).otherwise(0)).cast("int"), "approved": ~every(11)})
    parents = pages.withColumns({"sha": F.when(every(3), F.sha2(F.lit("x"), 256)).otherwise(F.col("sha")), "approved": ~every(13)}).filter(~every(5))
    first = pages.filter(every(2)).select("doc_id", "unit_id", "ordinal", F.when(every(7), "r0").otherwise("r1").alias("baseline"), F.when(every(9), "other").otherwise(F.col("sha")).alias("candidate"), F.when(every(4), "APPROVE").otherwise("PROPOSE").alias("disposition"), F.lit(1).alias("seq"))
    later = pages.filter(every(24)).select("doc_id", "unit_id", "ordinal", F.lit("r1").alias("baseline"), F.col("sha").alias("candidate"), F.lit("PROPOSE").alias("disposition"), F.lit(2).alias("seq"))
    revisions = pages.select("doc_id").distinct().select("doc_id", F.lit("r1").alias("parent"), (F.col("doc_id") % 4 == 3).alias("restores"))
    return C.page_change_kinds(pages, parents, first.unionByName(later), revisions)


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS pages FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 30")
def repeated_hash_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("pages")).filter("pages > 30")


@query("SELECT user_id, event_type, count(*) AS calls, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events GROUP BY 1, 2")
def running_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query("""SELECT l_orderkey, round(sum(CASE WHEN l_discount >= 0 THEN CAST(round(l_discount * 100) AS BIGINT) END)::DOUBLE / count(l_discount), 4) AS mean_confidence FROM lineitem GROUP BY 1""")
def mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double") / F.count("l_discount"), 4).alias("mean_confidence"))


@query("""SELECT user_id, arg_min(event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END * 10 + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS worst FROM events GROUP BY 1""")
def most_important_warning(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(9)
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct(rank, "event_type")).alias("worst"))


@query(f"WITH {DOCS} SELECT CASE WHEN status IN ('QUEUED', 'DETECTING') THEN 'BUSY' WHEN media_type <> 'text/html' THEN 'NO_IMAGES' ELSE 'ELIGIBLE' END AS outcome, count(*) AS n FROM docs GROUP BY 1")
def rescan_census(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("status").isin("QUEUED", "DETECTING"), "BUSY").when(F.col("media_type") != "text/html", "NO_IMAGES").otherwise("ELIGIBLE")
    return docs(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOCS} SELECT collection, sum(coalesce(CASE WHEN doc_id % 9 <> 0 THEN n_chars // 3000 + 1 END, 0))::BIGINT AS pages, bool_or(doc_id % 9 = 0) AS at_least,
  CASE WHEN bool_and(doc_id % 9 <> 0) THEN sum(n_chars // 3000 + 1)::BIGINT * 1500 * 3 END AS micro_cost FROM docs GROUP BY 1""")
def import_preview(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.when(F.col("doc_id") % 9 != 0, F.floor(F.col("n_chars") / 3000) + 1)
    total = F.sum(F.coalesce(pages, F.lit(0).cast("long")))
    return docs(spark, sf).groupBy("collection").agg(total.alias("pages"), F.bool_or(pages.isNull()).alias("at_least"), F.when(F.bool_and(pages.isNotNull()), F.sum(pages) * 1500 * 3).alias("micro_cost"))


@query(f"WITH {DOCS}, c AS (SELECT status, count(*) AS n FROM docs WHERE collection = 'src1' GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS n_statuses FROM c")
def collection_summary(spark: SparkSession, sf: str) -> DataFrame:
    counts = docs(spark, sf).filter("collection = 'src1'").groupBy("status").count()
    return counts.agg(F.sum("count").alias("total"), F.count("*").alias("n_statuses"))


# windows, sorts, limits


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def topk_per_key(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_id, ts) AS latest FROM events WHERE event_type = 'signup' GROUP BY 1")
def latest_job(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_by(table(spark, sf, "events").filter("event_type = 'signup'"), ["user_id"], "ts", "event_id", latest=True).withColumnRenamed("event_id", "latest")


@query(f"WITH {DOCS} SELECT doc_id, filename FROM docs ORDER BY created_at DESC, doc_id LIMIT 40 OFFSET 20")
def newest_page(spark: SparkSession, sf: str) -> DataFrame:
    return C.sorted_documents(docs(spark, sf), "NEWEST").select("doc_id", "filename").offset(20).limit(40)


@query(f"WITH {DOCS} SELECT doc_id, filename, row_number() OVER (ORDER BY lower(filename), doc_id) AS place FROM docs QUALIFY place <= 50")
def name_sort_nocase(spark: SparkSession, sf: str) -> DataFrame:
    top = C.sorted_documents(docs(spark, sf), "NAME_ASC").select("doc_id", "filename").limit(50)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.expr("filename COLLATE UNICODE_CI"), "doc_id")).cast("long"))


@query(f"WITH {UNITS} SELECT doc_id, ordinal, text FROM units WHERE doc_id = 8 AND ordinal > 3 ORDER BY ordinal LIMIT 5")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).filter("doc_id = 8 AND ordinal > 3").orderBy("ordinal").limit(5)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25")
def priority_order(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(rank, F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_orderstatus").limit(25)


@query(f"WITH {DOCS} SELECT doc_id, status FROM docs WHERE status = 'QUEUED' AND media_type IN ('text/html', 'text/csv') ORDER BY created_at, doc_id LIMIT 1")
def queue_claim(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).filter("status = 'QUEUED' AND media_type IN ('text/html', 'text/csv')").orderBy("created_at", "doc_id").select("doc_id", "status").limit(1)


# sets and sinks


@query("""SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 3 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') EXCEPT SELECT p_partkey FROM part WHERE p_size < 20""")
def orphan_paths_union(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").filter("l_quantity < 3").select(F.col("l_partkey").alias("k")).union(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey")).distinct()
    return both.join(table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("k")), "k", "left_anti")


@query(f"WITH {UNITS}, {EXTRACTED} SELECT doc_id, ordinal FROM units WHERE (doc_id, ordinal) NOT IN (SELECT (doc_id, ordinal) FROM extracted WHERE state = 'DONE' AND method = 'TEXT')")
def committed_keys(spark: SparkSession, sf: str) -> DataFrame:
    done = extracted(spark, sf).filter("state = 'DONE' AND method = 'TEXT'").select("doc_id", "ordinal")
    return units(spark, sf).select("doc_id", "ordinal").join(done, ["doc_id", "ordinal"], "left_anti")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def replace_document_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return C.replace_by_document(d.withColumn("version", F.lit("old")), d.filter("doc_id % 4 = 0").withColumn("version", F.lit("new")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_last_write(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return C.keep_last_write(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@query("SELECT sha256(text) AS sha, source, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1, 2")
def sha256_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha"), "source").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@query("SELECT o_custkey AS k, 'order' AS origin FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().withColumn("origin", F.lit("order"))
    return C.insert_absent(old, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin")), ["k"])


@query("SELECT user_id, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def counting_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"))


@query(f"""WITH {DOCS}, {UNITS}, c AS (SELECT doc_id, count(*) AS n_chunks FROM units GROUP BY 1), r AS (SELECT doc_id, count(*) AS n_rows FROM units WHERE NOT (doc_id % 10 = 3 AND ordinal = 1) GROUP BY 1)
  SELECT d.doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_rows, 0) AS n_rows FROM docs d LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)
  WHERE d.fingerprint IS DISTINCT FROM 'v1' OR coalesce(n_chunks, 0) <> coalesce(n_rows, 0)""")
def reindex_candidates(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return C.stale_documents(docs(spark, sf), u, u.filter("NOT (doc_id % 10 = 3 AND ordinal = 1)"), "v1")


@query("""SELECT timestamp, level, component, event_id FROM (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
  'c' || (user_id % 4) AS component, event_id FROM events) WHERE level IN ('WARN', 'ERROR') AND component = 'c1' AND timestamp >= '2024-01-10T00:00:00.000Z'""")
def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    rows = table(spark, sf, "events").select(C.iso_millis(F.col("ts")).alias("timestamp"), level.alias("level"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("component"), "event_id")
    return C.log_records(rows, "WARN", component="c1", since="2024-01-10T00:00:00.000Z")


@query("""SELECT event_id, earlier, earlier >= 3 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND 1 PRECEDING) AS earlier FROM events WHERE event_type = 'error')""")
def sliding_limit(spark: SparkSession, sf: str) -> DataFrame:
    return C.attempts_in_window(table(spark, sf, "events").filter("event_type = 'error'"), "user_id", minutes=720, most=3).select("event_id", "earlier", "refused")


@query("""SELECT conv_id, turn FROM (SELECT *, sum(CASE WHEN turn < 2 THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS head,
  sum(CASE WHEN turn >= 2 THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS tail FROM conversations) WHERE turn < 2 OR head + tail <= 2500""")
def budget_prune(spark: SparkSession, sf: str) -> DataFrame:
    return C.prune_to_fit(table(spark, sf, "conversations").withColumn("size", F.length("text")), 2500).select("conv_id", "turn")
