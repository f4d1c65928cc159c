"""Pages, evidence and small text operators as queries (PRJ-4, AG-21, FLT-2, SE-17, FN-3 to 37, QA-3, QA-4, STR-2, STR-6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import text as X
from stackroom.operators import catalog as C
from stackroom.operators import chunking, corrections, evidence, geometry, images, layout, structure
from stackroom.plans.query import Synonyms
from stackroom.plans.strings import plain_analyzer
from stackroom.queries.views import DOCS, EXTRACTED, UNITS, docs, extracted, units
from stackroom.session import spread, table
from stackroom.streaming import flows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT event_id, CASE WHEN code IN ('NEEDS_TOOL', 'NEEDS_TESSERACT', 'NEEDS_SURYA', 'NEEDS_LLAMA_CPP', 'NEEDS_SURYA_MODEL', 'SURYA_START_FAILED') THEN 'NEEDS_TOOL' ELSE 'FAILED' END AS status
  FROM (SELECT event_id, (['NEEDS_TOOL', 'NEEDS_TESSERACT', 'NEEDS_SURYA', 'NEEDS_LLAMA_CPP', 'NEEDS_SURYA_MODEL', 'SURYA_START_FAILED', 'UNREADABLE', 'TOO_LARGE', NULL])[event_id % 9 + 1] AS code FROM events)""")
def failure_status(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*map(F.lit, [*C.TOOL_CODES, "UNREADABLE", "TOO_LARGE", None]))
    return table(spark, sf, "events").select("event_id", C.failure_status(F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int"))).alias("status"))


@query(f"""WITH {UNITS}, p AS (SELECT doc_id, CASE WHEN ordinal % 6 = 5 THEN NULL ELSE text END AS published, length(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS a, length(regexp_replace(text, '\\s', '', 'g')) AS v FROM units)
  SELECT doc_id, count(*) AS document_pages, count_if(published IS NULL OR a < 40 OR (CASE WHEN v > 0 THEN a / v ELSE 0 END) < 0.5) AS pages_to_read FROM p GROUP BY 1""")
def page_census(spark: SparkSession, sf: str) -> DataFrame:
    pages = units(spark, sf).select("doc_id", F.col("ordinal").alias("page"), F.when(F.col("ordinal") % 6 != 5, F.col("text")).alias("published"), X.needs_ocr(F.col("text")).alias("policy"))
    return C.page_census(pages)


@query(f"""WITH {UNITS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS place FROM units), a AS (SELECT * FROM p WHERE ordinal = doc_id % 4)
  SELECT a.doc_id, a.ordinal AS asked, p.ordinal, p.place - a.place AS at, md5(p.text) AS digest FROM a JOIN p ON a.doc_id = p.doc_id AND p.place BETWEEN a.place - 2 AND a.place + 5""")
def units_around(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return C.units_around(u, u.filter("ordinal = doc_id % 4"), 2, 9).select("doc_id", "asked", "ordinal", F.col("at").cast("long").alias("at"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {UNITS}, u AS (SELECT doc_id, ordinal, CASE WHEN ordinal % 4 = 1 THEN '## ' || text ELSE text END AS text FROM units),
  t AS (SELECT doc_id, ordinal, regexp_extract(text, '^\\s*#{{1,6}}\\s+(.*)$', 1) AS title FROM u)
  SELECT doc_id, count(*) AS n_units, min(ordinal) AS first, max(ordinal) AS last, coalesce(string_agg(ordinal || ':' || substring(title, 1, 80), '|' ORDER BY ordinal) FILTER (title <> ''), '') AS headings FROM t GROUP BY 1""")
def structure_listing(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf).withColumn("text", F.when(F.col("ordinal") % 4 == 1, F.concat(F.lit("## "), "text")).otherwise(F.col("text")))
    joined = F.array_join(F.transform("headings", lambda h: F.concat(h["ordinal"].cast("string"), F.lit(":"), h["label"])), "|")
    return C.structure_listing(u).withColumn("headings", joined)


@query(f"WITH {DOCS} SELECT doc_id, filename FROM docs WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00' AND created_at < TIMESTAMP '2024-01-02 00:00:00' AND media_type IN ('text/csv') AND filename ILIKE '%doc-%'")
def normalized_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Blank values are absent, an until date is its whole day, instants come from any zone."""
    f = C.Filters("  ", ("text/csv", " "), " doc- ", "", "2024-01-01T03:00:00+02:00", " 2024-01-01 ")
    return C.find_documents(docs(spark, sf), f).select("doc_id", "filename")


@query("""WITH w AS (SELECT p_partkey, p_partkey % 6 AS k, regexp_extract_all(lower(p_name), '[\\p{L}\\p{M}\\p{N}]+') AS w, array_to_string(regexp_extract_all(lower(p_brand), '[\\p{L}\\p{M}\\p{N}]+'), ' ') AS b FROM part)
  SELECT p_partkey, CASE k WHEN 1 THEN array_to_string(w, ' ') || '|' || b WHEN 4 THEN array_to_string(w, ' ') || '|' || b || '|mit*' ELSE 'refused' END AS terms FROM w""")
def synonym_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which lists of terms are synonyms: two terms at least that differ, prefixes of one word with three characters or more."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 6
    lists = [
        F.array(name, F.upper(name)), F.array(name, F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.upper(name)), F.array(name, F.concat(F.substring("p_brand", 1, 2), F.lit("*"))), F.array("p_brand", F.concat(F.lit("x "), name, F.lit("*"))),
        F.array(name, "p_brand", F.lit("mit*")), F.array(name),
    ]
    own = reduce(lambda a, k: a.when(kind == k, lists[k]), range(1, 6), F.when(kind == 0, lists[0]))

    def make(r):
        try:
            return [(r.p_partkey, "|".join(" ".join(t.tokens) + "*" * t.prefix for t in Synonyms.of(list(r.terms), plain_analyzer).terms))]
        except ValueError:
            return [(r.p_partkey, "refused")]

    return _each(table(spark, sf, "part").select("p_partkey", own.alias("terms")), "p_partkey long, terms string", make)


@query(f"WITH {UNITS}, {EXTRACTED} SELECT doc_id, ordinal, kind FROM (SELECT doc_id, ordinal, 'open' AS kind FROM extracted WHERE state <> 'DONE' OR doc_id % 3 <> 1 UNION ALL SELECT doc_id, ordinal, 'retry' FROM extracted WHERE state = 'FAILED' AND doc_id % 3 = 1)")
def resumed_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units to read after a restart under fingerprint v1, and those of it that failed."""
    done = extracted(spark, sf).withColumn("fingerprint", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")))
    u = units(spark, sf).select("doc_id", "ordinal")
    kinds = [flows.resume(u, done, "v1", again).select("doc_id", "ordinal", F.lit(kind).alias("kind")) for again, kind in ((False, "open"), (True, "retry"))]
    return kinds[0].unionByName(kinds[1])


_RULES = [corrections.Rule("a", "released under", "published under"), corrections.Rule("b", "version", "edition")]


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 2")
def units_to_correct(spark: SparkSession, sf: str) -> DataFrame:
    """Units whose corrections are of another list of rules."""
    d = table(spark, sf, "documents").select("doc_id")
    before = d.filter("doc_id % 4 = 2 OR doc_id % 4 = 3").withColumn("rules_fingerprint", F.when(F.col("doc_id") % 4 == 2, corrections.list_fingerprint(_RULES)).otherwise("older"))
    return corrections.changed_only(d, before, _RULES)


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bRELEASED(\\s+)UNDER\\b', 'PUBLISHED\\1UNDER', 'g'), '\\bReleased(\\s+)under\\b', 'Published\\1under', 'g'), '\\breleased(\\s+)under\\b', 'published\\1under', 'g'),
  '\\bVERSION\\b', 'EDITION', 'g'), '\\bVersion\\b', 'Edition', 'g'), '\\bversion\\b', 'edition', 'g')) AS digest FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'RELEASED UNDER a VERSION. ' || text ELSE 'Released  under' || chr(10) || 'Version ' || text END AS text FROM documents)""")
def replacement_casing(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("doc_id") % 3, F.col("text")
    d = table(spark, sf, "documents").select("doc_id", F.when(k == 0, t).when(k == 1, F.concat(F.lit("RELEASED UNDER a VERSION. "), t)).otherwise(F.concat(F.lit("Released  under\nVersion "), t)).alias("text"))
    return corrections.correct(d, _RULES).select("doc_id", F.md5(F.col("corrected").cast("binary")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, text, substring(text, 1, list_max(list_filter(range(0, 201), lambda k: strlen(substring(text, 1, k::BIGINT)) <= 200))) AS cut FROM documents)
  SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text WHEN regexp_matches(cut, '(?s)^.+[ \\n]') THEN regexp_extract(cut, '(?s)^(.*)[ \\n]', 1) ELSE cut END AS prefix FROM p""")
def byte_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.mapped(table(spark, sf, "documents").select("doc_id", "text"), "text", lambda t: evidence.byte_prefix(t, 200), "string", "prefix").select("doc_id", "prefix")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{broken ' || event_id ELSE '{"a":[3,{"x":1,"y":null}],"b":"' || event_type || '","c":' || event_id || '}' END AS canonical FROM events""")
def canonical_arguments(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken "), i)).otherwise(F.concat(F.lit('{ "c": '), i, F.lit(', "b": "'), F.col("event_type"), F.lit('", "a": [3, {"y": null, "x": 1}] }')))
    return evidence.mapped(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw", evidence.canonical_json, "string", "canonical").select("event_id", "canonical")


@query("SELECT event_id, 'S' || event_id || ',S' || user_id AS ids FROM events")
def payload_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence ids at any depth of a tool's result."""
    payload = F.concat(F.lit('{"items": [{"evidenceId": "S'), F.col("event_id").cast("string"), F.lit('", "text": "x"}, {"inner": {"evidenceId": "S'), F.col("user_id").cast("string"), F.lit('"}}, {"evidenceId": 7}]}'))
    return evidence.mapped(table(spark, sf, "events").select("event_id", payload.alias("p")), "p", lambda p: ",".join(evidence.evidence_ids(p)), "string", "ids").select("event_id", "ids")


@query("""WITH p AS (SELECT item_id, text, strpos(text, 'e') AS p FROM benchmark), s AS (SELECT *, CASE WHEN p > 0 THEN regexp_extract(left(text, p), '^(.*\\s)?\\S*$', 1, 's') END AS head FROM p), w AS (SELECT *, regexp_extract(substr(text, length(head) + 1), '^\\S+') AS word FROM s),
  x AS (SELECT *, regexp_replace(word, 'e', 'E') AS new, substr(text, length(head) + length(word) + 1) AS rest FROM w)
  SELECT item_id, CASE WHEN p = 0 THEN 'added:Now |same:' || text WHEN head = '' THEN 'removed:' || word || '|added:Now ' || new ELSE 'added:Now |same:' || head || '|removed:' || word || '|added:' || new END || CASE WHEN p > 0 AND rest <> '' THEN '|same:' || rest ELSE '' END AS parts FROM x""")
def text_differences(spark: SparkSession, sf: str) -> DataFrame:
    """What is the same, removed and added between a text and another with a word before it and its first e in capitals."""
    b = table(spark, sf, "benchmark").select("item_id", "text", F.concat(F.lit("Now "), F.regexp_replace("text", "^([^e]*)e", "$1E")).alias("new"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [evidence.text_diff(old, new) for old, new in zip(pdf["text"], pdf["new"], strict=True)]
            yield pd.DataFrame({"item_id": pdf["item_id"], "parts": ["|".join(f"{k}:{t}" for k, t in parts) for parts in found]})

    return b.mapInPandas(run, "item_id long, parts string")


@query("SELECT conv_id, TRUE AS fits, TRUE AS in_order, least(sum(length(text)), 1)::BIGINT AS some FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def bounded_results(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns as a tool's result of 2,048 bytes at most: whether it fits, is in order, and holds something."""
    schema = "conv_id long, fits boolean, in_order boolean, some long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv, turns in zip(pdf["conv_id"], pdf["turns"], strict=True):
                kept = evidence.bounded([{"turn": int(t["turn"]), "text": t["text"]} for t in turns], lambda items: len(items) - 1)
                size = len(evidence.json.dumps(kept, ensure_ascii=False, separators=(",", ":")).encode())
                rows.append((conv, size <= evidence.RESULT_BYTES, [k["turn"] for k in kept] == sorted(k["turn"] for k in kept), min(1, sum(len(k["text"]) for k in kept))))
            yield pd.DataFrame(rows, columns=["conv_id", "fits", "in_order", "some"])

    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(turns.alias("turns")).mapInPandas(run, schema)


_PAGE = """'# Item ' || item_id || chr(10) || chr(10) || t || chr(10) || chr(10) || '- point' || chr(10) || '- ' || w || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || w || ' | 2 |'"""
_ITEMS = "i AS (SELECT item_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') AS t, regexp_extract_all(text, '[A-Za-z]+')[1] AS w FROM benchmark WHERE regexp_matches(text, '[A-Za-z]'))"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages (item_id, t, w, markdown) of a heading, a paragraph, a list and a table."""
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0))
    b = table(spark, sf, "benchmark").filter(F.size(words) > 0).select("item_id", F.array_join(words, " ").alias("t"), words[0].alias("w"))
    return b.withColumn("markdown", F.concat(F.lit("# Item "), F.col("item_id").cast("string"), F.lit("\n\n"), "t", F.lit("\n\n- point\n- "), "w", F.lit("\n\n| a | b |\n| --- | --- |\n| "), "w", F.lit(" | 2 |")))


def _each(rows: DataFrame, schema: str, make) -> DataFrame:
    """Rows made of each row by a function, in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for r in pdf.itertuples(index=False) for x in make(r)], columns=names)

    return rows.mapInPandas(run, schema)


@query(f"WITH {_ITEMS} SELECT item_id, md5({_PAGE}) AS digest FROM i")
def rendered_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A page's structure, rendered over its whole span, is the page."""

    def make(r):
        text, blocks = structure.place(structure.read_markdown(r.markdown))
        return [(r.item_id, structure.render(blocks, text, 0, len(text)))]

    return _each(_pages(spark, sf), "item_id long, shown string", make).select("item_id", F.md5(F.col("shown").cast("binary")).alias("digest"))


@query(f"WITH {_ITEMS}, s AS (SELECT item_id, length('Item ' || item_id) AS a, length(t) AS b, length(w) AS c FROM i) SELECT item_id, 'heading' AS kind, 0 AS start, a::INTEGER AS end, 1 AS level FROM s UNION ALL SELECT item_id, 'paragraph', (a + 1)::INTEGER, (a + 1 + b)::INTEGER, NULL FROM s"
       " UNION ALL SELECT item_id, 'list_item', (a + b + 2)::INTEGER, (a + b + 7)::INTEGER, NULL FROM s UNION ALL SELECT item_id, 'list_item', (a + b + 8)::INTEGER, (a + b + 8 + c)::INTEGER, NULL FROM s UNION ALL SELECT item_id, 'table', (a + b + c + 9)::INTEGER, (a + b + c + c + 15)::INTEGER, NULL FROM s")
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    made = structure.structured(_pages(spark, sf).select("item_id", "markdown"), keys=("item_id",))
    return made.select("item_id", F.explode("blocks").alias("b")).select("item_id", "b.kind", "b.start", "b.end", "b.level")


@query(f"WITH {_ITEMS} SELECT item_id, 'Item ' || item_id || '|' || t || '|points|' || w || '|a' || chr(9) || 'b' || chr(10) || w || chr(9) || '2' AS blocks FROM i")
def corrected_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks move with a correction of one of them."""
    matcher = corrections.Matcher([corrections.Rule("a", "point", "points")])

    def make(r):
        text, blocks = structure.place(structure.read_markdown(r.markdown.replace(r.t, r.t.replace("point", "p"))))
        new, moved, plain = structure.correct_blocks(text, blocks, matcher.edits(text))
        return [] if plain else [(r.item_id, "|".join(new[b.start : b.end] for b in moved))]

    return _each(_pages(spark, sf), "item_id long, blocks string", make)


@query(f"""WITH {_ITEMS} SELECT item_id, 'paragraph:' || w || '|heading:Item ' || item_id || '|list_item:point|list_item:' || w || '|caption:About|table:a' || chr(9) || 'b' || chr(10) || w || chr(9) || '2|paragraph:' || t AS blocks, FALSE AS degraded FROM i""")
def layout_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """An OCR engine's boxes in reading order: heading, list, table with its caption, text."""
    box = lambda html, label, order: F.struct(html.alias("html"), F.lit(label).cast("string").alias("label"), F.lit(order).cast("int").alias("reading_order"))
    w, t = F.col("w"), F.col("t")
    boxes = F.array(
        box(F.concat(F.lit("<p>"), t, F.lit("</p>")), "Text", None), box(F.concat(F.lit("<table><caption>About</caption><tr><th>a<th>b</tr><tr><td>"), w, F.lit("</td><td>2</td></tr></table>")), "Table", 4),
        box(F.concat(F.lit("<h2>Item <b>"), F.col("item_id").cast("string"), F.lit("</b></h2>")), "SectionHeader", 2), box(F.concat(F.lit("<ul><li>point<li>"), w, F.lit("</ul>")), "ListGroup", 3), box(F.concat(F.lit("<script>x()</script>"), w), None, 1),
    )
    made = layout.layout_structured(_pages(spark, sf).select("item_id", boxes.alias("layout")), keys=("item_id",))
    own = F.transform("blocks", lambda b: F.concat(b["kind"], F.lit(":"), F.substring(F.col("search_text"), b["start"] + 1, b["end"] - b["start"])))
    return made.select("item_id", F.array_join(own, "|").alias("blocks"), "degraded")


@query(f"""WITH {_ITEMS}, c AS (SELECT item_id, w, len(string_split(t, ' ')) AS n FROM i), x AS (SELECT item_id, 1 + item_id % 3 AS k, n, w FROM c)
  SELECT item_id, 'table:' || w || chr(9) || 'b' || chr(10) || 'c' || chr(10) || 'd' || '|figure:' AS blocks, '0,0,' || k || ',1 0,1,1,2 ' || CASE k WHEN 1 THEN '1,0,1,1 2,0,1,1' WHEN 2 THEN '1,1,1,1 2,0,1,1' ELSE '1,1,1,1 2,1,1,1' END AS spans, n / 100.0 AS right_edge FROM x""")
def layout_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that take several rows or columns push later ones aside; a picture without words keeps its box."""
    box = lambda html, label, order, right: F.struct(html.alias("html"), F.lit(label).alias("label"), F.lit(order).alias("reading_order"), F.array(F.lit(0.0), F.lit(0.0), right, F.lit(1.0)).alias("box"))
    k = (1 + F.col("item_id") % 3).cast("string")
    table_ = F.concat(F.lit('<table><tr><th rowspan="'), k, F.lit('">'), "w", F.lit('</th><td colspan="2">b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>'))
    right = F.size(F.split("t", " ")) / 100.0
    made = layout.layout_structured(_pages(spark, sf).select("item_id", F.array(box(table_, "Table", 1, F.lit(0.5)), box(F.lit(""), "Picture", 2, right)).alias("layout")), keys=("item_id",))
    own = F.transform("blocks", lambda b: F.concat(b["kind"], F.lit(":"), F.substring(F.col("search_text"), b["start"] + 1, b["end"] - b["start"])))
    spans = F.transform(F.col("blocks")[0]["spans"], lambda s: F.concat_ws(",", s["row"], s["column"], s["rows"], s["columns"]))
    return made.select("item_id", F.array_join(own, "|").alias("blocks"), F.array_join(spans, " ").alias("spans"), F.col("blocks")[1]["box"][2].alias("right_edge"))


@query(f"WITH {_ITEMS} SELECT item_id AS doc_id, 'Figure ' || item_id || ': ' || w AS caption, 'Body ' || w AS context FROM i")
def picture_captions(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled line under a picture is its caption, the rest of the page its context."""
    line = lambda text, top: F.struct(text.alias("text"), F.array(F.lit(0.1), F.lit(top), F.lit(0.6), F.lit(top + 0.02)).alias("box"))
    lines = F.array(line(F.concat(F.lit("Body "), "w"), 0.9), line(F.concat(F.lit("Figure "), F.col("item_id").cast("string"), F.lit(": "), "w"), 0.61))
    pages = _pages(spark, sf).select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page"), F.array(*map(F.lit, (0.1, 0.3, 0.6, 0.6))).alias("picture"), lines.alias("lines"))
    return images.captions(pages).select("doc_id", "caption", "context")


@query(f"WITH {_ITEMS} SELECT item_id, count(*) AS n_words, count(*) AS n_placed, sum(k)::DOUBLE AS sum_left FROM (SELECT item_id, unnest(range(len(string_split(t, ' ')))) AS k FROM i) GROUP BY 1")
def word_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of a page gets the box that OCR read it in."""
    words = F.transform(F.split("t", " "), lambda w, k: F.struct(w.alias("text"), F.array(k.cast("double"), F.lit(0.0), k + 1.0, F.lit(1.0)).alias("box")))
    found = geometry.align_pages(_pages(spark, sf).select("item_id", F.col("t").alias("text"), words.alias("words")), "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("kind") == "exact").alias("n_placed"), F.sum("left").alias("sum_left"))


_CHUNKED = "t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w, text FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{Nd}]') AND regexp_replace(text, '\\s', '', 'g') <> 'Â')"


@query(f"WITH {_CHUNKED} SELECT doc_id, 0 AS first_start, length(text)::INTEGER AS last_end, TRUE AS covered, TRUE AS within FROM t")
def chunk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A text's chunks cover it from end to end, overlap or touch, and stay within their budget."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    found = chunking.chunk_units(d, ["doc_id"], "text").select("doc_id", "chunk", F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.col("token_count").alias("n")).alias("x"))
    each = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    gaps = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x")), lambda a, b: (b["s"] <= a["e"]) & (b["s"] > a["s"]))
    return each.select("doc_id", F.col("x")[0]["s"].alias("first_start"), F.array_max(F.transform("x", lambda c: c["e"])).alias("last_end"), F.forall(gaps, lambda g: F.coalesce(g, F.lit(True))).alias("covered"), F.forall("x", lambda c: c["n"] <= chunking.BUDGET).alias("within"))


@query("SELECT p_partkey // 200 AS lot, TRUE AS headed, TRUE AS within, count(*) AS n_rows FROM part GROUP BY 1")
def chunk_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table's chunks each begin with its header and hold whole rows; every row is in one."""
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.regexp_replace("p_name", r"\s+", " "))
    tables = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 200).alias("lot")).agg(F.concat(F.lit("id\tname\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("search_text"), F.lit(True).alias("is_table"))
    found = chunking.chunk_units(tables, ["lot"], table_col="is_table", budget=64, overlap=0)
    rows = F.explode(F.filter(F.split("text", "\n"), lambda r: (r != "") & (r != "id\tname")))
    checked = found.groupBy("lot").agg(F.min(F.col("text").startswith("id\tname\n")).alias("headed"), F.min(F.col("token_count") <= 64).alias("within"))
    return checked.join(found.select("lot", rows.alias("row")).groupBy("lot").agg(F.count_distinct("row").alias("n_rows")), "lot")


@query("""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[A-Za-z]')) SELECT doc_id, 1 + greatest(0, ceil((n - 28) / 29.0))::BIGINT AS n_chunks, n AS n_rows, greatest(least(n, 28), least(n - 28, 29)) AS most_rows,
  TRUE AS headed FROM w""")
def chunk_structured(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a heading and a long table: chunks end with rows, and those that begin within the table repeat its first row."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    row = F.transform(words, lambda w, k: F.concat(F.lit("| "), k + 1, F.lit(" | "), w, F.lit(" |")))
    page = F.concat(F.lit("# Page "), F.col("doc_id").cast("string"), F.lit("\n\n| place | word |\n| --- | --- |\n"), F.array_join(row, "\n"))
    pages = spread(table(spark, sf, "documents").select("doc_id", "text")).filter(F.col("text").rlike("[A-Za-z]")).select("doc_id", page.alias("markdown"))
    found = chunking.chunk_pages(pages, ["doc_id"], budget=64, overlap=0)
    head = F.when(F.col("chunk") == 0, F.col("text").startswith("Page ")).otherwise(F.col("text").startswith("place\tword\n"))
    n = F.regexp_count("text", F.lit(r"(?md)^\d+\t[A-Za-z]+$")).cast("long")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(n).alias("n_rows"), F.max(n).alias("most_rows"), F.min(head).alias("headed"))


@query("SELECT conv_id, string_agg(role || '=' || regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '|' ORDER BY turn) AS events FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def server_events(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation sent as a stream of events is read back."""
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    sent = table(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.concat(F.lit(": note\nevent: "), "role", F.lit("\ndata: "), text, F.lit("\n\n")).alias("e"))
    sent = sent.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]), "").alias("stream"))
    return evidence.mapped(sent, "stream", lambda s: "|".join(f"{e}={d}" for e, d in evidence.turns_from_events(s.split("\n"))), "string", "events").select("conv_id", "events")


@query(f"WITH {_ITEMS} SELECT item_id, w || ' = ' || lower(w) || ' x' AS block FROM i")
def synonym_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Synonym groups as lines of a prompt."""
    return evidence.mapped(_pages(spark, sf).select("item_id", "w"), "w", lambda w: evidence.synonym_block([[w, w.lower() + "\tx"]]), "string", "block").select("item_id", "block")


@query("SELECT lang, TRUE AS within, TRUE AS in_order, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def passage_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A language's passages go to a model in runs whose padded size stays within its budget; a longer one goes alone."""
    d = spread(table(spark, sf, "documents").filter("lang IS NOT NULL").select("lang", "doc_id", "text"))
    stretches = chunking.stretches(d.select("lang", "doc_id", F.size(X.plain_tokens(F.col("text"))).alias("n")), "lang", "doc_id", "n")

    def make(r):
        own = [int(n) for n in r.lengths]
        runs = chunking.plan_batches(own)
        fits = all((b - a) * max(own[a:b]) <= 8192 or b - a == 1 for a, b in runs)
        return [(r.lang, fits, [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]], runs[-1][1])]

    each = _each(stretches, "lang string, within boolean, in_order boolean, n long", make)
    return each.groupBy("lang").agg(F.bool_and("within").alias("within"), F.bool_and("in_order").alias("in_order"), F.sum("n").alias("n"))
