"""Extraction, chunking, corrections and evidence as queries (SRC, FN-2, FN-6, AG-10, QA)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackroom.operators import chunking, corrections, evidence
from stackroom.operators.search import keyword
from stackroom.plans.query import Bool, Term
from stackroom.queries.search import _index as written_index
from stackroom.session import spread, table
from stackroom.sources import html, ocr, text, units

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH d AS (SELECT doc_id, '# Top ' || doc_id || chr(10) || text || chr(10) || '## Sub' || chr(10) || 'tail' AS text FROM documents), l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM d)),
  s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*#{1,6}\\s+.*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
  SELECT doc_id, section::BIGINT AS section, (min(n) + 1)::INTEGER AS first_line, (max(n) + 1)::INTEGER AS last_line, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM s GROUP BY 1, 2""")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# Top "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n## Sub\ntail")).alias("text"))
    return text.markdown_sections(d).select("doc_id", "section", "first_line", "last_line", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS a, length(text) AS size FROM (SELECT doc_id, repeat(text || chr(10), (doc_id % 13 + 1)::INTEGER) AS text FROM documents)), x AS (SELECT doc_id, size, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM d),
  l AS (SELECT doc_id, n, least(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n), size) AS upto, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS before, size FROM x),
  m AS (SELECT doc_id, n, upto, before, max(n) OVER (PARTITION BY doc_id) AS last FROM l WHERE before < size),
  u AS (SELECT doc_id, 1::BIGINT AS k, 1::BIGINT AS first FROM d UNION ALL SELECT u.doc_id, any_value(u.k) + 1, min(e.n) + 1 FROM u JOIN m s ON s.doc_id = u.doc_id AND s.n = u.first JOIN m e ON e.doc_id = u.doc_id AND e.n >= u.first AND (e.n = u.first + 199 OR e.upto - s.before >= 65536 OR e.n = e.last) GROUP BY u.doc_id, u.first HAVING min(e.n) < any_value(e.last))
  SELECT u.doc_id, max(k)::BIGINT AS n_units, any_value(z.last)::BIGINT AS last_line FROM u JOIN (SELECT doc_id, max(n) AS last FROM m GROUP BY 1) z USING (doc_id) GROUP BY 1""")
def plain_text_units(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.expr("repeat(concat(text, '\n'), cast(doc_id % 13 + 1 AS int))").alias("text"))
    return text.plain_units(d).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.max("locator.last").cast("long").alias("last_line"))


@query("""SELECT doc_id, len(string_split(text, chr(10)))::INTEGER - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n_lines, length(text)::INTEGER AS n FROM documents""")
def whole_text_units(spark: SparkSession, sf: str) -> DataFrame:
    return units.whole_text(table(spark, sf, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "n_lines", F.length("extracted_text").alias("n"))


@query(None)
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_units(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "ordinal", F.col("locator.name").alias("heading"), "search_text")


@query("""SELECT part AS file, (3 * part + k + 1)::BIGINT AS dummy, n::BIGINT AS n_units FROM (SELECT p_partkey // 500 AS part, 0 AS k, ceil(count(*) / 200) AS n FROM part GROUP BY 1)""")
def csv_units(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), "p_brand")
    files = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.concat(F.lit("id,name,brand\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n")).alias("content"))
    return text.csv_units(files, "content", ("file",)).groupBy("file").agg((3 * F.col("file") + 1).alias("dummy"), F.count("*").alias("n_units"))


@query("""WITH w AS (SELECT l_orderkey // 32 AS page, l_linenumber // 3 + 1 AS line, l_linenumber AS word, l_partkey % 97 AS conf, 'w' || l_partkey AS text, l_suppkey AS x, l_orderkey AS o FROM lineitem),
  g AS (SELECT page, line, string_agg(text, ' ' ORDER BY word, x, text) AS t, sum(conf) AS c, count(*) AS n FROM w GROUP BY 1, 2) SELECT page, string_agg(t, chr(10) ORDER BY line) AS text, round(sum(c) / sum(n) / 100, 6) AS confidence FROM g GROUP BY 1""")
def ocr_word_table(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    fields = [F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), s(F.floor(F.col("l_linenumber") / 3) + 1), s("l_linenumber"), s("l_suppkey"), F.lit("0"), F.lit("10"), F.lit("10"), s(F.col("l_partkey") % 97), F.concat(F.lit("w"), s("l_partkey"))]
    raw = lines.select(F.floor(F.col("l_orderkey") / 32).alias("page"), F.concat_ws("\t", *fields).alias("value"))
    extra = raw.select("page", F.concat(F.lit("4"), F.substring("value", 2, 1000)).alias("value"))
    return ocr.reading(ocr.read_words(raw.union(extra))).select("page", "text", F.round("confidence", 6).alias("confidence"))


@query(None)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return chunking.chunk_units(d, ["doc_id"], "text").select("doc_id", "chunk", "start_offset", "end_offset", "token_count", F.md5(F.col("text").cast("binary")).alias("digest"))


_RULES = [corrections.Rule("a", "released under", "published under"), corrections.Rule("b", "the MIT", "an MIT", True), corrections.Rule("c", "gnu general public license", "GPL")]


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)\\breleased\\s+under\\b'))::INTEGER AS a, len(regexp_extract_all(text, '\\bthe\\s+MIT\\b'))::INTEGER AS b, len(regexp_extract_all(text, '(?i)\\bgnu\\s+general\\s+public\\s+license\\b'))::INTEGER AS c FROM documents
  WHERE regexp_matches(text, '(?i)\\breleased\\s+under\\b|\\bgnu\\s+general\\s+public\\s+license\\b') OR regexp_matches(text, '\\bthe\\s+MIT\\b')""")
def correction_counts(spark: SparkSession, sf: str) -> DataFrame:
    done = corrections.correct(table(spark, sf, "documents").select("doc_id", "text"), _RULES).filter(F.size("edits") > 0)
    n = lambda r: F.size(F.filter("edits", lambda e: e["rule"] == r)).alias(r)
    return done.select("doc_id", n("a"), n("b"), n("c"))


@query("""SELECT * FROM (SELECT 'a' AS rule, sum(len(regexp_extract_all(text, '(?i)\\breleased\\s+under\\b')))::BIGINT AS n FROM documents UNION ALL SELECT 'b', sum(len(regexp_extract_all(text, '\\bthe\\s+MIT\\b')))::BIGINT FROM documents
  UNION ALL SELECT 'c', sum(len(regexp_extract_all(text, '(?i)\\bgnu\\s+general\\s+public\\s+license\\b')))::BIGINT FROM documents) WHERE n > 0""")
def rule_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corrections.counts_by_rule(corrections.correct(table(spark, sf, "documents").select("doc_id", "text"), _RULES))


@query(None)
def correction_preview(spark: SparkSession, sf: str) -> DataFrame:
    done = corrections.correct(table(spark, sf, "documents").select("doc_id", "text"), _RULES)
    return corrections.preview(done)[1]


#: Hits with their place, and what is kept of them one after the other: first those not like an earlier one, then those that fit.
_PACKED = """WITH RECURSIVE t AS (SELECT doc_id, source, text, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t),
  tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM t, unnest(w) u(term) WHERE term IN ('license', 'apache', 'version') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY 1),
  h AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, source, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM s JOIN t USING (doc_id) ORDER BY 1 LIMIT 30),
  k AS (SELECT 0::BIGINT AS step, [{'rank': 0::BIGINT, 'source': NULL::VARCHAR, 'bytes': 0::BIGINT, 'w': NULL::VARCHAR[]}] AS kept
    UNION ALL SELECT h.rank, CASE WHEN trim(text) = '' OR len(list_filter(kept, lambda x: x.w IS NOT NULL AND len(list_intersect(x.w, h.w)) >= 0.9 * greatest(len(x.w), len(h.w)))) > 0 THEN kept
      ELSE list_append(kept, {'rank': h.rank, 'source': h.source, 'bytes': octet_length(encode(text))::BIGINT, 'w': h.w}) END FROM k JOIN h ON h.rank = k.step + 1),
  f AS (SELECT x.rank AS rank, x.source AS source, x.bytes AS bytes FROM (SELECT unnest(kept[2:]) AS x FROM (SELECT kept FROM k ORDER BY step DESC LIMIT 1))),
  o AS (SELECT *, row_number() OVER (ORDER BY again, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) > 1 AS again FROM f)),
  p AS (SELECT 0::BIGINT AS step, 1000::BIGINT AS used, []::BIGINT[] AS taken UNION ALL SELECT o.place, CASE WHEN len(taken) < 12 AND used + bytes + 40 <= 20000 THEN used + bytes + 40 ELSE used END,
    CASE WHEN len(taken) < 12 AND used + bytes + 40 <= 20000 THEN list_append(taken, o.rank) ELSE taken END FROM p JOIN o ON o.place = p.step + 1),
  z AS (SELECT taken FROM p ORDER BY step DESC LIMIT 1), y AS (SELECT unnest(range(1, len(taken) + 1)) AS i, taken FROM z)
  SELECT 'S' || i AS evidence, source, taken[i] AS rank FROM y JOIN h ON h.rank = taken[i]"""


@query(_PACKED)
def pack_context(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of a question that go into a request of 20,000 bytes, of which 1,000 are taken and 40 go with each hit; those of sources not there yet first."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    hits = keyword(written_index(spark, sf), Bool(should=tuple(map(Term, ("license", "apache", "version")))), 30)
    w = Window.partitionBy().orderBy(F.col("score").desc(), "doc_id")
    ranked = hits.withColumns({"rank": F.row_number().over(w).cast("long"), "query_id": F.lit(1).cast("long")})
    return evidence.pack_context(ranked.join(d, "doc_id").select("query_id", "rank", "source", "text"), 20_000, document="source", base=1000, each=40).drop("query_id")


@query("SELECT conv_id, count(*)::BIGINT AS n_turns, min(CASE WHEN role = 'user' THEN turn END) AS first_user, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1 HAVING count(*) > 2 ORDER BY 4 DESC, 1 LIMIT 50")
def recent_conversations(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"), F.sum(F.length("text")).alias("chars"))
    return g.filter("n_turns > 2").orderBy(F.col("chars").desc(), "conv_id").limit(50)


@query("""WITH w AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS w FROM documents), s AS (SELECT doc_id, lang, w, min(doc_id) OVER (PARTITION BY lang, w) AS r FROM w WHERE len(w) > 0),
  r AS (SELECT * FROM s WHERE doc_id = r) SELECT r AS a, doc_id AS b, 'equal' AS kind FROM s WHERE doc_id <> r UNION ALL
  SELECT a.doc_id AS a, b.doc_id AS b, 'near' AS kind FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.9 * greatest(len(a.w), len(b.w)) WHERE len(list_intersect(a.w, b.w)) >= 0.9 * greatest(len(a.w), len(b.w))""")
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from stackroom.operators.neardup import word_set_pairs

    return word_set_pairs(spread(table(spark, sf, "documents").select("doc_id", "lang", "text")), "lang")


@query("""WITH i AS (SELECT l_suppkey % 20 AS doc_id, l_orderkey % 40 AS page, l_linenumber AS ordinal, CAST(l_partkey % 300 AS VARCHAR) AS sha256, (l_quantity * 10)::INTEGER AS width, (l_partkey % 500)::INTEGER AS height, l_orderkey AS o FROM lineitem),
  p AS (SELECT doc_id, sha256, count(DISTINCT page) AS pages FROM i GROUP BY 1, 2),
  r AS (SELECT CASE WHEN least(width, height) < 96 THEN 'TOO_SMALL' WHEN o % 3 <> 0 AND (o % 20 + 1) / 20.0 * 0.1 < 0.01 THEN 'TOO_SMALL' WHEN o % 11 = 0 THEN 'MASK' WHEN o % 13 = 0 THEN 'UNIFORM' WHEN pages > 3 THEN 'REPEATED' END AS reason FROM i JOIN p USING (doc_id, sha256))
  SELECT coalesce(reason, 'KEPT') AS reason, count(*) AS n FROM r GROUP BY 1""")
def image_filter(spark: SparkSession, sf: str) -> DataFrame:
    from stackroom.operators.images import skipped

    o = F.col("l_orderkey")
    box = F.when(o % 3 != 0, F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), ((o % 20 + 1) / 20.0).alias("right"), F.lit(0.1).alias("bottom")))
    pictures = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("doc_id"), (o % 40).alias("page"), F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 300).cast("string").alias("sha256"), F.round(F.col("l_quantity") * 10).cast("int").alias("width"),
        (F.col("l_partkey") % 500).cast("int").alias("height"), box.alias("box"), (o % 11 == 0).alias("is_mask"), (o % 13 == 0).alias("is_uniform"),
    )
    return skipped(pictures).groupBy(F.coalesce("reason", F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer, count(*) AS n_messages, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS output FROM conversations GROUP BY 1),
  e AS (SELECT user_id AS conv_id, count(*) AS calls, coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0)::BIGINT AS tokens FROM events WHERE event_type = 'click' GROUP BY 1)
  SELECT conv_id, question, answer, n_messages, output, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens FROM h LEFT JOIN e USING (conv_id) WHERE question IS NOT NULL ORDER BY conv_id DESC LIMIT 50""")
def ask_history(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda who: F.when(F.col("role") == who, F.col("turn"))
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.min_by("text", said("user")).alias("question"), F.max_by("text", said("assistant")).alias("answer"), F.count("*").alias("n_messages"), F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("output")
    )
    used = table(spark, sf, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("conv_id")).agg(F.count("*").alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    newest = talks.filter("question IS NOT NULL").orderBy(F.col("conv_id").desc()).limit(50)
    return newest.join(used, "conv_id", "left").select("conv_id", "question", "answer", "n_messages", "output", zero("calls"), zero("tokens"))
