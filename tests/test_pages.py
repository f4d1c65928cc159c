"""Page structure and pictures."""

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators import images as I
from stackroom.operators import structure as S
from stackroom.operators.corrections import Matcher, Rule

PAGE = """<!-- page-header -->
Running title
<!-- /page-header -->
# Top #
First **bold** and `code` line
second line

- item _one_
2. item two
```py
x = `1`
```
$$
a+b
$$
| H1 | H2 |
|----|:--:|
| a\\|b | c |
| d |
<!-- page-footer --> 7 <!-- /page-footer -->tail"""


def test_markdown_blocks():
    got = [(p.kind, p.text) for p in S.read_markdown(PAGE)]
    assert got == [
        ("page_header", "Running title"), ("heading", "Top"), ("paragraph", "First bold and code line\nsecond line"), ("list_item", "item one"), ("list_item", "2. item two"), ("code", "x = `1`"), ("formula", "a+b"), ("table", ""), ("page_footer", "7"), ("paragraph", "tail"),
    ]
    assert S.read_markdown(PAGE)[7].rows == ((("H1", True), ("H2", True)), (("a|b", False), ("c", False)), (("d", False),))
    assert [p.kind for p in S.read_markdown("<!-- page-header -->open\n#no\n$x$\n```\nnever closed")] == ["paragraph", "paragraph", "formula", "code"] and S.read_markdown("") == []


def test_ranges_and_rendering():
    text, blocks = S.place(S.read_markdown(PAGE))
    assert [text[b.start : b.end] for b in blocks][:3] == ["Running title", "Top", "First bold and code line\nsecond line"]
    table = next(b for b in blocks if b.kind == "table")
    assert [[text[c.start : c.end] for c in r] for r in table.rows] == [["H1", "H2"], ["a|b", "c"], ["d"]]
    whole = S.render(blocks, text, 0, len(text))
    assert whole == "# Top\n\nFirst bold and code line\nsecond line\n\n- item one\n- 2. item two\n\n``\n".replace("``\n", "```\nx = `1`\n```") + "\n\n$a+b$\n\n| H1 | H2 |\n| --- | --- |\n| a\\|b | c |\n| d |  |\n\ntail"
    last = table.rows[2][0]
    assert S.render(blocks, text, last.start, last.end) == "| H1 | H2 |\n| --- | --- |\n| d |  |"
    assert S.render(blocks, text, blocks[2].start + 6, blocks[2].start + 10) == "bold" and S.render([], "abc", 1, 2) == "b"


def test_windows():
    text, blocks = S.place(S.read_markdown("# One\n\ntwo three"))
    cut = S.window(blocks, 2, 7)
    assert [(b.kind, b.start, b.end) for b in cut] == [("heading", 0, 1), ("paragraph", 2, 5)] and text[2:7][2:5] == "two"


def test_corrections_move_blocks():
    text, blocks = S.place(S.read_markdown("# teh top\n\n| teh | x |\n|---|---|\n| y | teh |"))
    new, moved, plain = S.correct_blocks(text, blocks, Matcher([Rule("1", "teh", "these")]).edits(text))
    assert not plain and [new[b.start : b.end] for b in moved] == ["these top", "these\tx\ny\tthese"] and [[new[c.start : c.end] for c in r] for r in moved[1].rows] == [["these", "x"], ["y", "these"]]
    _, moved, plain = S.correct_blocks(text, blocks, Matcher([Rule("1", "x y", "z")]).edits(text))
    assert plain and {b.kind for b in moved} == {"paragraph"}


def test_spans_hold_their_words():
    rng = random.Random(3)
    parts = ["# head", "word one two", "- item", "| a | b |\n|---|---|\n| c | d |", "```\ncode\n```"]
    for _ in range(60):
        text, blocks = S.place(S.read_markdown("\n\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))))
        a, b = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        shown = S.render(blocks, text, a, b)
        assert all(w in shown for w in text[a:b].split())


def test_structure_job(spark):
    d = spark.createDataFrame([(1, "# A\n\nb"), (2, None)], "page_id int, markdown string")
    got = {r["page_id"]: (r["search_text"], [tuple(b) for b in r["blocks"]]) for r in S.structured(d).collect()}
    assert got == {1: ("A\nb", [("heading", 0, 1, 1), ("paragraph", 2, 3, None)]), 2: ("", [])}


def test_pictures_are_skipped_for_reasons(spark):
    box = "struct<left:double,top:double,right:double,bottom:double>"
    rows = [(1, 0, 0, "small", 95, 500, None, False, False), (1, 0, 1, "thin", 500, 500, (0.0, 0.0, 0.05, 0.1), False, False), (1, 0, 2, "mask", 200, 200, None, True, False), (1, 0, 3, "flat", 200, 200, None, False, True), (1, 0, 4, "kept", 200, 200, (0.0, 0.0, 1.0, 1.0), False, False)]
    rows += [(1, p, 9, "logo", 200, 200, None, False, False) for p in range(4)] + [(2, p, 0, f"p{p}", 200, 200, None, False, False) for p in range(502)]
    df = spark.createDataFrame(rows, f"doc_id int, page int, ordinal int, sha256 string, width int, height int, box {box}, is_mask boolean, is_uniform boolean")
    got = {}
    for r in I.skipped(df).collect():
        got.setdefault((r["doc_id"], r["reason"]), set()).add(r["sha256"])
    assert got[1, "TOO_SMALL"] == {"small", "thin"} and got[1, "MASK"] == {"mask"} and got[1, "UNIFORM"] == {"flat"} and got[1, "REPEATED"] == {"logo"} and got[1, None] == {"kept"} and got[2, "LIMIT"] == {"p500", "p501"}
    assert {r["sha256"] for r in df.filter(I.is_scan(F.col("box"))).collect()} == {"kept"}


def test_picture_identity(spark):
    a = I.picture_id("d", "u", "EMBEDDED", "s", None, 1)
    assert a == I.picture_id("d", "u", "EMBEDDED", "s", None, 1) != I.picture_id("d", "u", "EMBEDDED", "s", None, 2) and a[14] == "5"
    assert I.picture_id("d", "u", "PAGE_REGION", None, (0.1, 0.1, 0.2, 0.20004), 1) == I.picture_id("d", "u", "PAGE_REGION", None, (0.1, 0.1, 0.2, 0.2), 1)
    with pytest.raises(ValueError):
        I.picture_id("d", "u", "PAGE_REGION", "s", None, 1)
    df = spark.createDataFrame([(0, 1), (2, 1000), (1_147_483, 1), (0, 1001)], "p int, i int")
    assert [r[0] for r in df.select(I.picture_ordinal(F.col("p"), F.col("i"))).collect()] == [1_000_000_000, 1_000_002_999, None, None]
    units = spark.createDataFrame([(1, 0, True), (1, 1_000_000_000, False), (2, 0, False), (2, 1_000_000_000, False), (3, 0, True)], "doc_id int, ordinal long, empty boolean")
    assert {r["doc_id"]: r["picture_only"] for r in I.picture_only(units).collect()} == {1: True, 2: False, 3: False}


def test_captions(spark):
    picture = (0.1, 0.3, 0.6, 0.6)
    at = lambda text, top, left=0.1, right=0.6: (text, [left, top, right, top + 0.02])
    pages = {  # lines of a page in any order, and what of them is the caption
        "two lines below": ([at("Above text", 0.26), at("sits here", 0.64), at("Figure 2: A cat", 0.61), at("Far away body", 0.8), at("Other column", 0.61, 0.7, 0.9)], "Figure 2: A cat sits here"),
        "a label above": ([at("Fig. 1 above", 0.27), at("plain below", 0.61)], "Fig. 1 above"),
        "nothing near": ([at("far", 0.7), at("far above", 0.1)], None),
        "three lines at most": ([at(f"line {k}", 0.61 + 0.03 * k) for k in range(5)], "line 0 line 1 line 2"),
        "a gap ends it": ([at("first", 0.61), at("second", 0.67)], "first"),
        "above ends with its label": ([at("body before", 0.21), at("Table 3 - sizes", 0.24), at("in cm", 0.27)], "Table 3 - sizes in cm"),
        "words that only begin like labels": ([at("Figurative text", 0.27), at("Tables turn", 0.61)], "Tables turn"),
        "below first, unless above has the label": ([at("BILD 7", 0.27), at("Foto: x", 0.61)], "Foto: x"),
        "narrow overlap": ([at("beside", 0.61, 0.5, 0.9)], None),
        "long lines and blanks": ([at("x" * 401, 0.61), at(" \n", 0.62), at("after", 0.62)], "after"),
        "no lines": ([], None),
    }
    rows = [(k, 0, list(picture), lines) for k, (lines, _) in enumerate(pages.values())]
    df = spark.createDataFrame(rows, "doc_id long, page int, picture array<double>, lines array<struct<text:string,box:array<double>>>")
    got = {r["doc_id"]: r for r in I.captions(df).collect()}
    assert {name: got[k]["caption"] for k, name in enumerate(pages)} == {name: want for name, (_, want) in pages.items()}
    assert "Above text" in got[0]["context"] and "Figure 2" not in got[0]["context"] and len(I.context(picture, [("word " * 400, (0, 0, 1, 0.1))])) <= 600


def test_alignment():
    from stackroom.operators import geometry as G

    box = lambda k: (float(k), 0.0, k + 1.0, 1.0)
    words = ["The", "qu1ck", "brown", "f", "ox", "jumpsover", "the", "the", "dog", "noise"]
    got = G.align("The quick brown fox jumps over the lazy dog.", [(w, box(k)) for k, w in enumerate(words)])
    assert [p.kind for p in got] == ["exact", "near", "exact", "cut", "run", "run", "exact", "none", "exact"]
    assert got[3].box == (3.0, 0.0, 5.0, 1.0) and got[4].box == got[5].box == box(5) and got[7].box is None
    assert G.align("", []) == [] and [p.kind for p in G.align("a b", [])] == ["none", "none"]
    assert [p.kind for p in G.align("aaaa bbbb aaaa bbbb", [("aaaa", box(0)), ("bbbb", box(1)), ("aaaa", box(2)), ("bbbb", box(3))], budget=3)] == ["none"] * 4
    assert G.one_edit("hello", "helo") and G.one_edit("hello", "hallo") and not G.one_edit("abc", "abd") and not G.one_edit("hello", "hlleo")


def test_alignment_is_whole_for_equal_words():
    from stackroom.operators import geometry as G

    rng = random.Random(2)
    for _ in range(30):
        words = [rng.choice("alpha beta gamma delta eps".split()) + str(rng.randrange(30)) for _ in range(40)]
        got = G.align(" ".join(words), [(w, (float(k), 0.0, 0.0, 0.0)) for k, w in enumerate(words)])
        assert [p.box[0] for p in got] == list(map(float, range(40)))


def test_alignment_job(spark):
    from stackroom.operators import geometry as G

    df = spark.createDataFrame([(1, "one two", [("one", [0.0, 0.0, 1.0, 1.0])]), (2, None, None)], "page_id int, text string, words array<struct<text:string,box:array<double>>>")
    assert [(r["page_id"], r["kind"], r["right"]) for r in G.align_pages(df).collect()] == [(1, "exact", 1.0), (1, "none", None)]


def test_plain_tables_are_read_at_once_and_as_others():
    """Lines of plain cells give the rows that they give cell by cell, and their ranges are known without making a cell."""
    rng = random.Random(3)
    for _ in range(3000):
        lines = ["".join(rng.choice(["|", " ", "a", "b1", "  ", "|", "-", "||"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        lines = [x if "|" in x else x + "|" for x in lines]
        assert S._plain_rows(lines) == tuple(tuple((c, k == 0) for c in S._cells(x)) for k, x in enumerate(lines)), lines
    assert S._plain_rows(["a | *b*"]) is None and S._plain_rows(["a \\| b |"]) is None and S._plain_rows(["é|"]) is None and S._plain_rows(["a\tb|"]) is None
    text, (block,) = S.place(S.read_markdown("| a | b |\n|-|-|\n" + "| 1 | |\n" * 3))
    assert isinstance(block.rows, S.PlacedRows) and [text[a:b] for a, b in zip(*block.rows.ranges(), strict=True)] == ["a\tb", "1\t", "1\t", "1\t"]
    assert [[(text[c.start : c.end], c.header) for c in r] for r in block.rows][:2] == [[("a", True), ("b", True)], [("1", False), ("", False)]]


def test_pages_are_chunked_in_one_step_as_in_two(spark):
    from stackroom.operators import chunking as C

    rng = random.Random(4)
    table = lambda mark: "| a | b |\n|-|-|\n" + "".join(f"| {k} | {rng.choice(['x', 'yy zz', mark])} |\n" for k in range(rng.randrange(40)))
    pages = ["\n\n".join(rng.choice(["# one", "some words in a row " * rng.randrange(9), table("w"), table("*é*"), "<!-- page-header -->\nrunning\n<!-- /page-header -->"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    d = spark.createDataFrame([*enumerate(pages), (100, None), (101, "")], "k int, markdown string")
    for overlap in (0, 5):
        two = C.chunk_units(S.structured(d, keys=("k",), rows=True), ["k"], blocks_col="blocks", budget=24, overlap=overlap)
        one = C.chunk_pages(d, ["k"], budget=24, overlap=overlap)
        assert one.count() > 60 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_words_are_placed_at_once_as_one_by_one():
    from stackroom.operators import chunking as C

    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "é", "\U0001f600", " ", "\n", " ", "　", "\x1c", "​", " "]) for _ in range(rng.randrange(12)))
        assert list(zip(*C._places(text), strict=True)) == C.whitespace_tokens(text), ascii(text)
