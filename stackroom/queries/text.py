"""Text functions (FN, FLT-7, FLT-8) and evidence functions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackroom.functions import text as X
from stackroom.queries.views import UNITS, units
from stackroom.session import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: lines with what normalisation acts on
_DIRTY = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(65279) || text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 2 THEN replace(text, ' ', chr(7) || ' ') ELSE replace(text, chr(10), chr(13)) END AS text FROM documents"


@query(f"WITH d AS ({_DIRTY}) SELECT doc_id, md5(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(text, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g')), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) AS digest FROM d")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 4
    dirty = F.when(k == 0, F.concat(F.lit("﻿"), t)).when(k == 1, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.replace(t, F.lit(" "), F.lit("\a "))).otherwise(F.replace(t, F.lit("\n"), F.lit("\r")))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize(dirty).cast("binary")).alias("digest"))


@query(f"WITH {UNITS} SELECT doc_id, ordinal FROM units WHERE regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]') AND regexp_replace(text, '\\s', '', 'g') <> 'Â'")
def searchable_filter(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).filter(X.searchable(F.col("text"))).select("doc_id", "ordinal")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT doc_id, count_if(regexp_matches(w, '[\\p{L}\\p{Nd}]\\p{M}*[\\p{L}\\p{Nd}]') OR regexp_matches(w, '[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]')) AS n_meaning, count(*) AS n FROM w GROUP BY 1""")
def meaning_filter(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(X.carries_meaning(F.col("w"))).alias("n_meaning"), F.count("*").alias("n"))


_SCORE = """CASE WHEN regexp_matches(s, '\\S') THEN floor(least(greatest(100.0 - junk / chars * 200.0 - len(list_filter(words, lambda w: length(w) <= 2)) / greatest(len(words), 1) * 80.0 - len(list_filter(words, lambda w: length(w) >= 18)) / greatest(len(words), 1) * 100.0
  - len(list_filter(tokens, lambda t: regexp_matches(t, '\\p{Nd}') AND regexp_matches(t, '[A-Za-zÅÄÖåäö]'))) / greatest(len(tokens), 1) * 150.0 - CASE WHEN letters > 0 THEN abs(vowels / letters - 0.4) * 100.0 ELSE 0.0 END, 0.0), 100.0) * 10 + 0.5) / 10.0 END"""
_SAMPLE = """SELECT *, length(s)::DOUBLE AS chars, length(regexp_replace(s, '[\\p{L}\\p{Nd}\\s.,;:!?"''()\\-—–…/\\\\\\[\\]{}<>]', '', 'g'))::DOUBLE AS junk, regexp_extract_all(s, '[A-Za-zÅÄÖåäö\\-]+') AS words, regexp_extract_all(s, '\\S+') AS tokens,
  length(regexp_replace(s, '\\P{L}', '', 'g'))::DOUBLE AS letters, length(regexp_replace(s, '[^aeiouyåäöAEIOUYÅÄÖ]', '', 'g'))::DOUBLE AS vowels FROM (SELECT *, substring(text, 1, 4000) AS s FROM %s)"""


@query(f"SELECT doc_id, {_SCORE}::DOUBLE AS score FROM ({_SAMPLE % 'documents'})")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.quality_score(F.col("text")).alias("score"))


@query(f"WITH {UNITS}, s AS (SELECT *, {_SCORE}::DOUBLE AS score FROM ({_SAMPLE % 'units'})) SELECT doc_id, floor(sum(score * chars) / sum(CASE WHEN score IS NOT NULL THEN chars END) * 10 + 0.5) / 10.0 AS score FROM s GROUP BY 1")
def document_quality_weighted(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text"))
    return d.select("doc_id", X.quality_sums(F.split("text", "\n")).alias("sums")).groupBy("doc_id").agg(X.mean_of_sums(F.col("sums")).alias("score"))


@query(f"""WITH {UNITS}, c AS (SELECT doc_id, ordinal, length(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS a, length(regexp_replace(text, '\\s', '', 'g')) AS v FROM units)
  SELECT doc_id, ordinal, a < 40 OR (CASE WHEN v > 0 THEN a / v ELSE 0 END) < 0.5 AS needs FROM c""")
def needs_ocr(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("doc_id", "ordinal", X.needs_ocr(F.col("text")).alias("needs"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN TRUE WHEN a < 40 OR (CASE WHEN v > 0 THEN a / v ELSE 0 END) < 0.5 THEN TRUE WHEN score >= 75 THEN FALSE ELSE (doc_id % 100) / 100.0 >= 0.25 END AS read FROM
  (SELECT doc_id, {_SCORE} AS score, length(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS a, length(regexp_replace(text, '\\s', '', 'g')) AS v FROM ({_SAMPLE % 'documents'}))""")
def page_policy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.page_policy(F.col("text"), (F.col("doc_id") % 100) / 100.0, F.col("doc_id") % 10 != 0).alias("read"))


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark),
  x AS (SELECT item_id, w AS a, CASE WHEN item_id % 3 = 0 THEN w[2:] WHEN item_id % 3 = 1 THEN w[6:] ELSE list_append(w, 'extra') END AS b FROM w)
  SELECT item_id, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) >= 0.9 * greatest(len(a), len(b)) AS duplicate FROM x""")
def near_duplicate_test(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "benchmark").select("item_id", X.near_dup_words(F.col("text")).alias("a"))
    k = F.col("item_id") % 3
    b = F.when(k == 0, F.slice("a", 2, F.size("a"))).when(k == 1, F.slice("a", 6, F.size("a"))).otherwise(F.array_append("a", F.lit("extra")))
    return words.select("item_id", X.is_near_duplicate(F.col("a"), b).alias("duplicate"))


@query("SELECT conv_id, turn, replace(replace(replace('<' || role || ' a=\"1\"> & ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown FROM conversations")
def escape_evidence(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("<"), "role", F.lit(' a="1"> & '), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.escape_evidence(raw).alias("shown"))


@query("""WITH a AS (SELECT o_orderkey, 'See [S' || o_custkey % 9 || '] and [S' || o_orderkey % 5 || '][S' || o_custkey % 9 || '] not [S] or (S1)' AS answer FROM orders),
  c AS (SELECT o_orderkey, list_distinct(regexp_extract_all(answer, '\\[(S[0-9]+)\\]', 1)) AS cited FROM a), s AS (SELECT ['S1', 'S2', 'S3', 'S4', 'S5'] AS supplied)
  SELECT o_orderkey, list_aggregate(list_sort(list_filter(cited, lambda x: list_contains(supplied, x))), 'string_agg', ',') AS valid, list_aggregate(list_sort(list_filter(cited, lambda x: NOT list_contains(supplied, x))), 'string_agg', ',') AS invalid FROM c, s""")
def citation_validation(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: c.cast("string")
    answer = F.concat(F.lit("See [S"), s(F.col("o_custkey") % 9), F.lit("] and [S"), s(F.col("o_orderkey") % 5), F.lit("][S"), s(F.col("o_custkey") % 9), F.lit("] not [S] or (S1)"))
    supplied = F.array(*[F.lit(f"S{k}") for k in range(1, 6)])
    cited = table(spark, sf, "orders").select("o_orderkey", X.citations(answer).alias("cited"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.sort_array(c), ","))
    return cited.select("o_orderkey", text(F.array_intersect("cited", supplied)).alias("valid"), text(F.array_except("cited", supplied)).alias("invalid"))


@query("""SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT p_partkey // 50 AS part, lower(p_name) || chr(9) || p_brand || chr(9) || CASE WHEN p_size > 25 THEN 'exact' ELSE 'any' END AS line FROM part) GROUP BY 1""")
def rule_list_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("\t", F.lower("p_name"), "p_brand", F.when(F.col("p_size") > 25, "exact").otherwise("any"))
    return table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


@query("SELECT doc_id, sha256('source=' || source || chr(10) || 'language=' || lang || chr(10) || 'ocr=' || coalesce(CASE WHEN doc_id % 2 = 0 THEN 'auto' END, '') || chr(10) || 'version=4') AS fingerprint FROM documents")
def extraction_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.fingerprint(source=F.col("source"), language=F.col("lang"), ocr=F.when(F.col("doc_id") % 2 == 0, "auto"), version=F.lit(4)).alias("fingerprint"))


@query("""SELECT conv_id, sum(strlen(text) + strlen(role) + 24)::BIGINT AS bytes, sum(strlen(text) + strlen(role) + 24) + 512 + 1024 <= 4096 AS fits FROM conversations GROUP BY 1""")
def request_budget(spark: SparkSession, sf: str) -> DataFrame:
    size = F.sum(F.octet_length("text") + F.octet_length("role") + 24)
    return table(spark, sf, "conversations").groupBy("conv_id").agg(size.alias("bytes"), (size + 512 + 1024 <= 4096).alias("fits"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (n_chars // 3000 + 1) * 1200 * 0.15 / 1000000 END::DOUBLE AS cost, CASE WHEN doc_id % 6 = 0 THEN 'unpriced' END AS reason FROM documents""")
def ocr_cost(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.floor(F.col("n_chars") / 3000) + 1
    priced = F.col("doc_id") % 6 != 0
    return table(spark, sf, "documents").select("doc_id", F.when(priced, pages * 1200 * 0.15 / 1000000).cast("double").alias("cost"), F.when(~priced, "unpriced").alias("reason"))


@query("SELECT l_orderkey, l_linenumber, 1000000000 + l_orderkey * 1000 + l_linenumber - 1 AS ordinal FROM lineitem WHERE l_linenumber BETWEEN 1 AND 1000")
def image_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_linenumber BETWEEN 1 AND 1000").select("l_orderkey", "l_linenumber", (F.lit(1_000_000_000) + F.col("l_orderkey") * 1000 + F.col("l_linenumber") - 1).alias("ordinal"))


@query("SELECT doc_id, substring(text, 101, 200) AS shown, length(text) > 300 AS more, strlen(substring(text, 101, 200))::INTEGER AS bytes FROM documents")
def text_window(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.substring("text", 101, 200)
    return table(spark, sf, "documents").select("doc_id", shown.alias("shown"), (F.length("text") > 300).alias("more"), F.octet_length(shown).alias("bytes"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'stored' END, sha256(text)) AS digest FROM documents")
def page_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.text_digest(F.when(F.col("doc_id") % 3 == 0, "stored"), F.col("text")).alias("digest"))


@query("""SELECT p_partkey, CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(65 + n // 26 - 1) || chr(65 + n % 26) ELSE chr(65 + (n - 702) // 676) || chr(65 + (n - 702) // 26 % 26) || chr(65 + (n - 702) % 26) END AS letters
  FROM (SELECT p_partkey, p_partkey::INTEGER AS n FROM part)""")
def column_letters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.column_letter(F.col("p_partkey").cast("int") + 1).alias("letters"))


@query("""SELECT s_suppkey, CASE WHEN regexp_matches(name, '^(?i:heading|rubrik|überschrift|titre)\\s*[1-9]$') THEN CAST(regexp_extract(name, '([1-9])$', 1) AS INTEGER) END AS level
  FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Heading ' WHEN 1 THEN 'Rubrik' WHEN 2 THEN 'TITRE ' WHEN 3 THEN 'Body ' ELSE 'heading  ' END || (s_suppkey % 10) AS name FROM supplier)""")
def heading_level(spark: SparkSession, sf: str) -> DataFrame:
    from stackroom.sources.office import heading_level_of

    k = F.col("s_suppkey") % 5
    name = F.concat(F.when(k == 0, "Heading ").when(k == 1, "Rubrik").when(k == 2, "TITRE ").when(k == 3, "Body ").otherwise("heading  "), (F.col("s_suppkey") % 10).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", heading_level_of(name).alias("level"))


@query("""WITH e AS (SELECT o_orderkey, [struct_pack(s := 5, e := 8, r := 'long word'), struct_pack(s := 20, e := 26, r := 'x')] AS edits, o_orderkey % 40 AS p FROM orders)
  SELECT o_orderkey, CASE WHEN p > 5 AND p < 8 THEN 5 WHEN p > 20 AND p < 26 THEN 26 ELSE p + CASE WHEN p >= 8 THEN 6 ELSE 0 END + CASE WHEN p >= 26 THEN -5 ELSE 0 END END::BIGINT AS moved FROM e""")
def offset_map(spark: SparkSession, sf: str) -> DataFrame:
    edits = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(r).alias("replacement")) for s, e, r in ((5, 8, "long word"), (20, 26, "x"))])
    return table(spark, sf, "orders").select("o_orderkey", X.map_offset((F.col("o_orderkey") % 40).cast("int"), edits).cast("long").alias("moved"))


@query("""WITH b AS (SELECT conv_id, turn, greatest(sum(length(text) + 1) OVER w - length(text) - 1, 0)::BIGINT AS s, sum(length(text) + 1) OVER w::BIGINT - 1 AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, greatest(s, 400) - 400 AS start, least(e, 1200) - 400 AS end_ FROM b WHERE s < 1200 AND e > 400""")
def structure_window(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text") + 1).over(w) - 1
    blocks = table(spark, sf, "conversations").select("conv_id", "turn", end.alias("e"), (end - F.length("text")).alias("s"))
    low, high = F.lit(400).cast("long"), F.lit(1200).cast("long")
    return blocks.filter("s < 1200 AND e > 400").select("conv_id", "turn", (F.greatest("s", low) - 400).alias("start"), (F.least("e", high) - 400).alias("end_"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS norm, round(p[1] / sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS first_ FROM
  (SELECT vec_id, list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2) AS p FROM embeddings)""")
def pool_and_normalize(spark: SparkSession, sf: str) -> DataFrame:
    half = lambda k: F.slice("embedding", k, 32)
    pooled = F.zip_with(half(1), half(33), lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x))
    return table(spark, sf, "embeddings").select("vec_id", pooled.alias("p")).select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("p", 1) / norm, 6).alias("first_"))


@query("""WITH r AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id)[1:10] AS a, list(event_id ORDER BY value + event_id % 3 DESC, event_id)[1:10] AS b FROM events GROUP BY 1)
  SELECT user_id, len(list_intersect(a, b)) / 10.0::DOUBLE AS overlap, (a[1] = b[1]) AS same_top, round(0.1 * list_sum(list_transform(range(1, 11), lambda d: power(0.9, d - 1) * len(list_intersect(a[1:d], b[1:d])) / d)), 6) AS rbo FROM r""")
def rbo_metric(spark: SparkSession, sf: str) -> DataFrame:
    from stackroom.operators.search import rank_metrics

    e = table(spark, sf, "events")
    ranked = lambda key, name: e.groupBy("user_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-key).alias("k"), "event_id"))), lambda x: x["event_id"]), 1, 10).alias(name))
    both = ranked(F.col("value"), "a").join(ranked(F.col("value") + F.col("event_id") % 3, "b"), "user_id")
    overlap, same, rbo = rank_metrics(F.col("a"), F.col("b"))
    return both.select("user_id", overlap.alias("overlap"), same.alias("same_top"), F.round(rbo, 6).alias("rbo"))
