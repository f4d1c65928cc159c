"""Sources, chunks, corrections, evidence and streams."""

import io
import json
import random
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stackroom.operators import chunking as K
from stackroom.operators import corrections as R
from stackroom.operators import evidence as E
from stackroom.queries import files as files_queries
from stackroom.session import shared_folder
from stackroom.sources import ebook, files, html, logs, office, text, units
from stackroom.sources.archive import SafeArchive, canonical, resolve
from stackroom.streaming import flows


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


# sources


def test_plain_text_batches():
    got = list(text.plain_text("a\r\nb\rc\nd", lines=2))
    assert [(u[1], u[2], u[5]) for u in got] == [(1, 2, "a\r\nb\r"), (3, 4, "c\nd")]
    assert [(u[1], u[2]) for u in text.plain_text("xxxx\n" * 5, chars=10)] == [(1, 2), (3, 4), (5, 5)] and list(text.plain_text("")) == []


def test_markdown_sections(spark):
    d = spark.createDataFrame([(1, "intro\n# A\nx\n  ## B\ny\n#no\n====="), (2, "")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["section"], r["first_line"], r["last_line"], r["text"]) for r in text.markdown_sections(d).collect())
    assert got == [(1, 0, 1, 1, "intro"), (1, 1, 2, 3, "# A\nx"), (1, 2, 4, 7, "  ## B\ny\n#no\n====="), (2, 0, 1, 1, "")]


def test_csv_rows():
    content = 'id,note\n1,"a, b"\n,\n2,"two\nlines"\n\n'
    (unit,) = text.csv_table(content)
    assert unit[1:4] == (2, 4, "table!A2:B4") and unit[5] == "id\tnote\n1\ta, b\n2\ttwo lines\n"
    assert [u[1] for u in text.csv_table("h\n" + "x\n" * 450)] == [2, 202, 402]


PAGE = """<html lang="sv"><head><title>T &amp; x</title><style>p{}</style></head><body>before<h1>One</h1><p>a <b>b</b>&amp;c</p><script>no()</script><div>own<h2>Two</h2><ul><li>i</li><li>j</li></ul></div><table><tr><td>x</td><td>y</td></tr></table><h1>Three</h1><h3>Deep</h3>tail</body></html>"""


def test_html_sections():
    got = [(u[4], u[5]) for u in html.html_sections(PAGE)]
    assert [g[0] for g in got][1:] == [["One"], ["One", "Two"], ["Three"], ["Three", "Deep"]]
    flat = "\n".join(t for _, t in got)
    assert "a b&c" in flat and "before tail" in flat and "no()" not in flat and "i j" in flat and "x y" in flat and flat.count("Two") == 1
    page = html.parse_page(PAGE)
    assert page.title == "T & x" and page.lang == "sv"
    with pytest.raises(units.Refused):
        list(html.html_sections("x" * (html.MOST_BYTES + 1)))


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = {
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="r1"><w:name w:val="Rubrik 2"/></w:style></w:styles>',
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="r1"/></w:pPr><w:r><w:t>Sub</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
}
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
XLSX = {
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Target="worksheets/s1.xml"/>'),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>Ann</t></si></sst>",
    "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>sum</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
}
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PPTX = {
    "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Target="slides/slide1.xml"/>'),
    "ppt/slides/slide1.xml": f"<p:sld {A}><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:sld>", "ppt/slides/_rels/slide1.xml.rels": REL.format('<Relationship Id="r1" Target="../notesSlides/notesSlide1.xml"/>'),
    "ppt/notesSlides/notesSlide1.xml": f"<p:notes {A}><a:p><a:r><a:t>Say hi</a:t></a:r></a:p><a:p><a:r><a:t>Master</a:t></a:r></a:p></p:notes>", "ppt/notesSlides/_rels/notesSlide1.xml.rels": REL.format('<Relationship Id="r1" Target="../notesMasters/notesMaster1.xml"/>'),
    "ppt/notesMasters/notesMaster1.xml": f"<p:notesMaster {A}><a:p><a:r><a:t>Master</a:t></a:r></a:p></p:notesMaster>",
}
EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>',
    "OPS/p.opf": '<package><manifest><item id="c1" href="c%201.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c1"/><itemref idref="n" linear="no"/></spine></package>',
    "OPS/nav.xhtml": '<html><body><nav><a href="c%201.xhtml">First</a></nav></body></html>', "OPS/c 1.xhtml": "<html><body><p>Chapter text</p></body></html>",
}
FB2 = "<FictionBook><body><section><title><p>Part</p></title><section><title><p>One</p></title><p>Text</p></section></section></body></FictionBook>"


def test_office_files():
    assert [(u[4], u[1], u[2], u[5]) for u in office.word(zipped(DOCX))] == [(["Top"], 1, 2, "Top\none\ttwo"), (["Top", "Sub"], 3, 4, "Sub\na | b")]
    (u,) = office.spreadsheet(zipped(XLSX))
    assert u[1:4] == (3, 3, "Data!A3:C3") and u[5] == "name\t\tsum\nAnn\t\t2\n"
    (u,) = office.slides(zipped(PPTX))
    assert u[5] == "Hello\nSay hi"


def test_books():
    (u,) = ebook.epub(zipped(EPUB))
    assert u[4] == ["First"] and u[5] == "Chapter text"
    with pytest.raises(units.Refused):
        list(ebook.epub(zipped(EPUB | {"META-INF/rights.xml": "x"})))
    want = [(["Part"], "Part"), (["Part", "One"], "One\nText")]
    assert [(u[4], u[5]) for u in ebook.fb2(FB2.encode())] == want == [(u[4], u[5]) for u in ebook.fb2(zipped({"b.fb2": FB2}))]


def test_archives_are_limited():
    for bad in ("../x", "/x", "a/../../x", "c:/x"):
        with pytest.raises(units.Refused):
            canonical(bad)
    assert resolve("a/b.x", "../c%20d#f") == "c d"
    for bad in (b"nothing", zipped({"big": b"\0" * (5 << 20)}), zipped({"../x": "y"})):
        with pytest.raises(units.Refused):
            SafeArchive(bad)
    with pytest.raises(units.Refused):
        list(office.word(zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})))


def test_folder_to_units(spark, tmp_path):
    root = tmp_path / "in"
    for name, content in {"a.txt": b"hello\n", "sub/b.md": b"# x", "sub/t.csv": b"h\n1\n", "d.docx": zipped(DOCX), "e.epub": zipped(EPUB), "f.fb2": FB2.encode(), "p.html": PAGE.encode(), "skip/n.txt": b"no", "x.bin": b"\0\1", "i.png": b"\x89PNG", "z.docx": b"PK broken"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    found = files.walk(spark, str(root), ignore=["skip/"], exclude=["bin"])
    typed = found.withColumn("media_type", files.media_type(F.col("content"), F.col("path")))
    kinds = {r["path"]: r["media_type"] for r in typed.select("path", "media_type").collect()}
    assert kinds == {
        "a.txt": "text/plain", "sub/b.md": "text/markdown", "sub/t.csv": "text/csv", "d.docx": list(files.ZIP_PARTS.values())[0], "e.epub": files.EPUB, "f.fb2": files.FB2, "p.html": "text/html", "i.png": "image/png", "z.docx": "application/zip",
    }
    got = {r["path"] for r in files.extract_all(typed).collect()}
    assert got == {"a.txt", "sub/b.md", "sub/t.csv", "d.docx", "e.epub", "f.fb2", "p.html"}
    bad = spark.createDataFrame([("x", bytearray(b"junk")), ("y", bytearray(zipped(DOCX))), ("z", None)], "path string, content binary")
    assert [tuple(r) for r in units.refused(bad, office.word, "content", ["path"]).collect()] == [("x", "not an archive")]
    old = files.older_than(found, 7, F.lit(datetime.now() + timedelta(days=8)).cast("timestamp"))
    assert old.count() == found.count() and files.older_than(found, 7, F.current_timestamp()).count() == 0


def test_logs(spark, tmp_path):
    path = tmp_path / "logs"
    path.mkdir()
    (path / "a.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00.000Z","level":"WARN","message":"m"}\nbroken\n{"level":"INFO"}\n')
    assert [r["message"] for r in logs.read_logs(spark, str(path)).collect()] == ["m"]
    q = logs.follow_logs(spark, str(path)).writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    (path / "b.jsonl").write_text('{"timestamp":"2024-01-02T00:00:00.000Z","level":"ERROR","message":"n"}\n')
    q.processAllAvailable()
    q.stop()
    assert {r["message"] for r in spark.table("followed").collect()} == {"m", "n"}


# chunks


def test_chunks_cover_overlap_and_fit():
    rng = random.Random(7)
    for _ in range(150):
        t = "".join(rng.choice(["word ", "x", "\n", "  ", "long-token ", "é "]) for _ in range(rng.randrange(1, 300)))
        budget, overlap = rng.choice([(10, 0), (12, 3), (40, 10), (5, 1)])
        chunks, _ = K.chunk_text(t, budget=budget, overlap=overlap)
        covered = {i for c in chunks for i in range(c.start, c.end)}
        assert all(i in covered for i, ch in enumerate(t) if ch.isalnum())
        for a, b in zip(chunks, chunks[1:], strict=False):
            assert b.start > a.start and b.end > a.end
        for k, c in enumerate(chunks):
            assert c.ordinal == k and c.text == t[c.start : c.end] and c.tokens == 3 + len(c.text.split()) <= budget


def test_chunk_ends_and_headers():
    t = "a b c d e\nf g h i j k"
    assert [c.text for c in K.chunk_text(t, budget=11, overlap=0)[0]] == ["a b c d e", "\nf g h i j k"]
    table = "h1 h2\n" + "".join(f"r{k} v{k}\n" for k in range(10))
    chunks, dropped = K.chunk_text(table, header="h1 h2\n", budget=11, overlap=0)
    assert not dropped and all(c.text.startswith("h1 h2\n") for c in chunks) and len(chunks) > 2
    assert K.chunk_text(table, header="too many header words here\n", budget=6, overlap=0)[1]
    assert K.chunk_text("Â", budget=10, overlap=0) == ([], False) and K.chunk_text("", budget=10, overlap=0)[0] == []
    assert [c.text for c in K.chunk_text("a b c", budget=3, overlap=0)[0]] == ["a b c"]
    with pytest.raises(ValueError):
        K.chunk_text("x", budget=5, overlap=5)


def test_structured_chunks():
    head, rows = "k v", [f"r{k} x{k} y{k}" for k in range(8)]
    t = "Intro words here.\n" + "\n".join([head, *rows])
    at, spans = t.index(head), []
    for r in [head, *rows]:
        a = t.index(r, at)
        spans.append((a, a + len(r)))
    blocks = [K.Block(0, 17), K.Block(t.index(head), len(t), "table", tuple(spans))]
    chunks, _ = K.chunk_text(t, blocks=blocks, budget=13, overlap=0)
    later = [c for c in chunks if c.start > spans[1][0]]
    assert later and all(c.text.startswith("k v\n") for c in later) and all(any(c.end == e for _, e in spans) for c in chunks if c.start >= spans[0][0])
    two = K.chunk_text("page head\nbody text", blocks=[K.Block(0, 9, "header"), K.Block(10, 19)], budget=50, overlap=0)[0]
    assert [c.text for c in two] == ["page head", "\nbody text"]


def test_chunk_job(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h", False), (2, None, False), (3, "h\n1\n2", True)], "doc_id int, search_text string, t boolean")
    got = [(r["doc_id"], r["chunk"], r["text"]) for r in K.chunk_units(d, ["doc_id"], table_col="t", budget=7, overlap=1).orderBy("doc_id", "chunk").collect()]
    assert got[:3] == [(1, 0, "a b c d "), (1, 1, "d e f g "), (1, 2, "g h")] and got[3][0] == 3
    assert K.plan_batches([5, 5, 10, 1], 15) == [(0, 2), (2, 3), (3, 4)] and K.plan_batches([]) == []


# corrections


def test_corrections():
    r = R.Rule
    m = R.Matcher([r("1", "teh", "the"), r("2", "teh cat", "the dog"), r("3", "NASA", "Nasa", True), r("4", "strasse", "street"), r("5", "漢", "汉"), r("6", "café", "bar")])
    apply = lambda t: m.apply(t)[0]
    assert apply("teh Teh TEH tehx xteh") == "the The THE tehx xteh" and apply("Teh\ncat sat") == "The\ndog sat" and apply("nasa NASA") == "nasa Nasa"
    assert apply("Straße") == "Street" and apply("x漢y") == "x汉y" and apply("cafe\u0301!") == "bar!" and apply("e\u0301 teh") == "e\u0301 the"
    text_, edits = m.apply("a teh b")
    assert [(e.start, e.end, e.replacement, e.rule) for e in edits] == [(2, 5, "the", "1")] and m.apply("the")[1] == [] and text_ == "a the b"
    same = [r("b", "x y", "1"), r("a", "x y", "2"), r("c", "X Y", "3", True)]
    for rules in (same, same[::-1]):
        assert R.Matcher(rules).apply("X Y x y")[0] == "3 2"
    assert R.list_fingerprint(same) == R.list_fingerprint(same[::-1])


def test_correction_jobs(spark):
    d = spark.createDataFrame([(1, "teh a teh"), (2, None), (3, "fine")], "doc_id int, text string")
    done = R.correct(d, [R.Rule("1", "teh", "the")])
    assert {r["doc_id"]: r["corrected"] for r in done.collect()} == {1: "the a the", 2: None, 3: "fine"}
    totals, shown = R.preview(done)
    assert tuple(totals.first()) == (2, 1) and [(r["before"], r["found"], r["after"]) for r in shown.collect()] == [("", "teh", " a teh"), ("teh a ", "teh", "")]
    old = spark.createDataFrame([(1, R.list_fingerprint([R.Rule("1", "teh", "the")])), (3, "x")], "doc_id int, rules_fingerprint string")
    assert sorted(r["doc_id"] for r in R.changed_only(d, old, [R.Rule("1", "teh", "the")]).collect()) == [2, 3]


# evidence


def test_choice_of_evidence(spark):
    hits = [("a", "one two three"), ("a", "one TWO, three"), ("a", "four five"), ("b", " \n"), ("b", "six seven"), ("c", "x" * 100), ("d", None)]
    df = spark.createDataFrame([(q, k, d, t) for q in (1, 2) for k, (d, t) in enumerate(hits)], "query_id int, rank int, doc_id string, text string")

    def taken(budget, most=12, **more):
        rows = sorted((r["query_id"], int(r["evidence"][1:]), r["rank"]) for r in E.pack_context(df, budget, most=most, **more).collect())
        found = {q: [k for x, n, k in rows if x == q] for q in (1, 2)}
        assert found[1] == found[2] and [n for x, n, _ in rows if x == 1] == list(range(1, len(found[1]) + 1))
        return found[1]

    assert taken(1000, 3) == [0, 4, 5] and taken(1000) == [0, 4, 5, 2] and taken(40) == [0, 4, 2] and taken(5) == []
    assert taken(60, base=20) == [0, 4, 2] and taken(60, base=20, each=10) == [0] and taken(1000, per_query=1) == [0]


def test_bounded_results():
    items = [{"id": k, "text": ("word " * 200).strip()} for k in range(3)]
    out = E.bounded(items, lambda x: len(x) - 1, 1500)
    assert len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()) <= 1500 and out[0]["id"] == 0
    assert out[-1]["text"].split() == ["word"] * len(out[-1]["text"].split()) and sum("truncated" in x for x in out) == 1
    assert E.bounded(items, lambda x: 0, 100_000) == items and E.bounded([{"text": "word"}], lambda x: 0, 5) == [] and E.bounded([], lambda x: 0) == []
    hard = [{"text": "\\\"\n" * 50 + " end " + "å" * 300, "x": "\t"}, {"text": "b b b"}]
    for most in range(20, 900, 37):
        kept = E.bounded(hard, lambda x: len(x) - 1, most)
        assert len(E._json(kept).encode()) <= most or kept == []
    assert E.byte_prefix("åäö ab", 7) == "åäö" and E.byte_prefix("åäö", 3) == "å" and E.byte_prefix("x", 5) == "x"


def test_small_functions(spark):
    assert E.canonical_json('{"b":1,"a":{"d":2,"c":[2,1]}}') == '{"a":{"c":[2,1],"d":2},"b":1}' and E.canonical_json("nope") == "nope"
    assert E.evidence_ids('{"evidenceId":"a","x":[{"evidenceId":"b"},{"evidenceId":3}]}') == ["a", "b"] and E.evidence_ids("x") == []
    assert E.text_diff("a b c", "a x c") == [("same", "a "), ("removed", "b"), ("added", "x"), ("same", " c")] and E.text_diff("", "") == [] and E.text_diff("a", "b", 0) is None
    assert E.synonym_block([["a\n", "b"], ["c", "d"]], most_units=8) == "a  = b"
    assert list(E.turns_from_events(iter(["event: x\n", "data: 1\n", "data:2\n", "\n", ": c\n", "data: z\n"]))) == [("x", "1\n2"), ("message", "z")]
    df = E.mapped(spark.createDataFrame([('{"b":1,"a":2}',), (None,)], "j string"), "j", E.canonical_json, "string", "c")
    assert [r["c"] for r in df.collect()] == ['{"a":2,"b":1}', None]


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_edits_are_shortest():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        parts = list(E._edits(a, b))
        assert [t for k, t in parts if k != "added"] == a and [t for k, t in parts if k != "removed"] == b
        assert sum(k == "same" for k, _ in parts) == longest_common(a, b)


def test_diff_restores_both_texts():
    assert E.text_diff("a b c d", "a x y d") == [("same", "a "), ("removed", "b c"), ("added", "x y"), ("same", " d")]  # changes beside a blank are one
    assert E.text_diff("x\ny z\n", "x\nY z\n", 3) == [("same", "x\ny z\n".replace("y z\n", "")), ("removed", "y"), ("added", "Y"), ("same", " z\n")]
    assert E.text_diff("a b\nc d\n", "a x\nc y\n", 4) == [("removed", "a b\nc d\n"), ("added", "a x\nc y\n")]  # by lines
    rng = random.Random(3)
    for _ in range(100):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        parts = E.text_diff(a, b)
        assert "".join(t for k, t in parts if k != "added") == a and "".join(t for k, t in parts if k != "removed") == b


# streams


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    spark.createDataFrame([("a", start + timedelta(minutes=k), False) for k in range(4)] + [("b", start, True)], "who string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = flows.watch_folder(spark, str(tmp_path / "in"), "who string, ts timestamp, ok boolean")
    q = flows.limited(src, most=3).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["who"], r["ts"], r["refused"]) for r in spark.table("limited").collect())
    assert [g[2] for g in got] == [False, False, False, True, False]


def test_replacing_sink_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    sink = flows.replace_into(str(tmp_path / "t"), lambda df: df.withColumn("bucket", F.col("doc_id") % 2))
    for _ in range(2):
        sink(rows, 0)
    sink(rows.filter("doc_id = 1").withColumn("v", F.lit("c")), 1)
    assert {(r["doc_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, "b")}


def test_resume(spark):
    u = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, ordinal int")
    c = spark.createDataFrame([(1, 0, "f", "DONE"), (1, 1, "f", "FAILED"), (1, 2, "old", "DONE")], "doc_id int, ordinal int, fingerprint string, state string")
    assert sorted(r["ordinal"] for r in flows.resume(u, c, "f").collect()) == [1, 2] and [r["ordinal"] for r in flows.resume(u, c, "f", True).collect()] == [1]


def test_stream_deduplication_and_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    spark.createDataFrame([("c", "h", start, "x", 1.0), ("c", "h", start, "x", 2.0), ("d", "h", start + timedelta(hours=2), "x", 3.0)], "collection string, sha256 string, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    src = flows.watch_folder(spark, str(tmp_path / "e"), "collection string, sha256 string, ts timestamp, event_type string, value double")
    for name, df in (("once", flows.first_copies(src)), ("windows", flows.windowed_counts(src))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 2 and [(r["n"], r["total"]) for r in spark.table("windows").collect()] == [(2, 3.0)]


def test_ignored_folders_are_never_listed(spark, tmp_path):
    from stackroom.sources import files

    for folder in ("a/b/c", "a/skip/deep/deeper", "skip/x", "d"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "t.txt").write_text(folder)
    (tmp_path / "top.md").write_text("top")
    entered = spark.sparkContext.accumulator(0)
    found = {r["path"]: r["is_dir"] for r in files.listed(spark, str(tmp_path), ignore=["skip/"], entered=entered).collect()}
    assert found == {"a": True, "a/b": True, "a/b/c": True, "d": True, "a/b/c/t.txt": False, "d/t.txt": False, "top.md": False}
    assert entered.value == 5  # the root, a, a/b, a/b/c and d
    got = {r["path"]: bytes(r["content"]) for r in files.walk_pruned(spark, f"file://{tmp_path}", ignore=["skip/"], include=["txt"]).collect()}
    assert got == {"a/b/c/t.txt": b"a/b/c", "d/t.txt": b"d"}
    assert {r["path"] for r in files.walk_pruned(spark, str(tmp_path), recursive=False).collect()} == {"top.md"}


def test_stretches_give_the_runs_of_the_whole_group(spark):
    import random

    rng = random.Random(3)
    rows = [(g, k, rng.choice((0, 1, 2, 3, 5, 9)) if g != "c" else 1) for g in "abc" for k in range(300)]
    rows += [("d", 5, 9), ("d", 5, 2), ("d", 6, None)]
    data = spark.createDataFrame(rows, "g string, k long, n int").repartition(7)
    total = {}
    for r in K.stretches(data, "g", "k", "n", 10).collect():
        total.setdefault(r["g"], []).append([b - a for a, b in K.plan_batches(r["lengths"], 10)])
    for g in "abcd":
        whole = [n or 0 for _, _, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] or 0))]
        assert sorted(x for own in total[g] for x in own) == sorted(b - a for a, b in K.plan_batches(whole, 10))
    assert len(total["a"]) > 10 and len(total["c"]) == 1


def _dealt_documents(spark, tmp_path):
    """Forty documents in four files, and the folders of the shared folder before a query."""
    spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'de', 'en') AS lang", "'src0' AS source").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return set(Path(shared_folder(spark).removeprefix("file:")).glob("*"))


def test_buckets_come_in_by_many_tasks(spark, tmp_path):
    before = _dealt_documents(spark, tmp_path)
    assert {tuple(r) for r in files_queries.stream_replaced_partitions(spark, str(tmp_path)).select("bucket", "n").collect()} == {(k, 5) for k in range(8)}
    (root,) = [p for p in set(Path(shared_folder(spark).removeprefix("file:")).glob("*")) - before if p.name.startswith("stream-")]
    assert len(list(root.glob("in/part=3/*.parquet"))) > 1


def test_walked_files_are_written_in_parts(spark, tmp_path):
    before = _dealt_documents(spark, tmp_path)
    assert [tuple(r) for r in files_queries.folder_walk(spark, str(tmp_path)).select("lang", "n_files", "n_old").collect()] == [("de", 1, 1)]
    assert [tuple(r) for r in files_queries.pruned_walk(spark, str(tmp_path)).select("source", "n_files").collect()] == [("src0", 1)]
    roots = [p for p in set(Path(shared_folder(spark).removeprefix("file:")).glob("*")) - before if p.name.startswith("walk-")]
    assert len(roots) == 2 and all(len(list(p.rglob("*.txt"))) > 2 for p in roots)


def test_long_tables_are_chunked_in_proportion():
    """A table's rows are not gone through again for each chunk: ends are found by as many comparisons as bisections need."""

    class Row(tuple):
        looks = 0

        def __getitem__(self, k):
            Row.looks += 1
            return tuple.__getitem__(self, k)

    body, rows, at = [], [], 0
    for k in range(2000):
        body.append(f"{k} w")
        rows.append(Row((at, at + len(body[-1]))))
        at += len(body[-1]) + 1
    found = K.chunk_text("\n".join(body), None, [K.Block(0, at - 1, "table", tuple(rows))], 64, 0)[0]
    assert len(found) > 60 and Row.looks < 20 * len(rows)
