"""The operators' queries over the input tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import chat_format, decontam, fill_in_middle, fingerprint, importance, language_id, license_scan, near_dup, quality_classifier, quality_rules, sentencepiece_nbest, substring_dedup, url_filter
from stackroom.session import cut, table


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def _fold(column: str, n: int):
    """Remainder of the id's CRC-32 as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir)).drop("text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(_docs(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_filter.mine(url_filter.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, mined)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode(_docs(spark, sf_dir)).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(quality_rules.measure(_docs(spark, sf_dir)).drop("text"))
    judged = quality_rules.judge(counts, counts=counts)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(_docs(spark, sf_dir))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlaps(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_turns(rows.unionByName(extra)))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), where=_fold("doc_id", 3) != 1)
    found = quality_classifier.predict(docs.withColumn("held_out", _fold("doc_id", 3) == 1), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "lang")
    model = language_id.train(docs, where=_fold("doc_id", 4) != 2)
    found = language_id.predict(docs.drop("lang").withColumn("held_out", _fold("doc_id", 4) == 2), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.restore(fill_in_middle.arrange(_docs(spark, sf_dir)))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_url_filter, op4_sentencepiece, op5_quality_rules, op6_near_dup, op7_decontam, op8_chat_format, op9_quality_classifier, op10_language_id, op11_fill_in_middle, op12_importance, op13_fingerprint)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
_ALNUM_WORDS = f"coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
_SPACED_WORDS = f"coalesce(regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), [])"

#: Other results are learned or searched, and can't be said in SQL as a whole; all are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_near_dup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED_WORDS} AS w FROM documents),
  i AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM w),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT doc_id, doc_id AS m FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
  SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id, r.doc_id = min(m) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op7_decontam": f"""WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS} AS w FROM benchmark),
  bk AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0), bi AS (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk), bw AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi),
  dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k), di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dk), dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM di),
  m AS (SELECT doc_id, k, i, item FROM dw JOIN bw USING (k, g)), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
  t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_chat_format": """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\#:<]', '', 'g')))::BIGINT AS formatted_chars FROM c GROUP BY 1""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS d FROM documents),
  h AS (SELECT doc_id, t, n, [('0x' || d[8 * k - 7 : 8 * k])::BIGINT FOR k IN [1, 2, 3, 4]] AS h FROM d),
  c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_importance": f"""WITH RECURSIVE steps AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
  bytes AS (SELECT list(c ORDER BY i) AS by_byte FROM steps WHERE k = 8),
  d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS w FROM d), g AS (SELECT unnest({_ALNUM_WORDS}) AS w FROM benchmark),
  v AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM g)),
  crc AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::BIGINT FOR k IN range(1, octet_length(encode(w)) + 1)], lambda a, x: xor(a >> 8, by_byte[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS b FROM v, bytes),
  s AS (SELECT b, count(*) AS s FROM f JOIN crc USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN crc USING (w) GROUP BY b), a AS (SELECT (SELECT sum(s) FROM s)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
  gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), a),
  w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id),
  x AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT::DOUBLE AS h FROM d LEFT JOIN w USING (doc_id)),
  y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM y WHERE n_features >= 20)
  SELECT y.*, CASE WHEN r <= floor(10 * n / 100) THEN r END AS rank FROM y LEFT JOIN r USING (doc_id)""",
}
