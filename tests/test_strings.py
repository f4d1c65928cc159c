"""What is typed, as trees; OCR layouts as structure; many queries at once."""

import numpy as np
import pytest

from stackroom.operators import layout as L
from stackroom.operators import search as S
from stackroom.plans import strings as P
from stackroom.plans.query import Bool, Boost, Fuzzy, Nothing, Phrase, Prefix, QueryTooLong, Regex, Term, Wildcard, simplify

A, B, C = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize("typed,want", [
    ("a b", Bool(should=(A, B))), ("+a -b", Bool(must=(A,), must_not=(B,))), ("a AND b OR c", Bool(must=(A, B), should=(C,))), ("a && NOT b", Bool(must=(A,), must_not=(B,))), ("!a || b", Bool(should=(B,), must_not=(A,))),
    ('"x y"~2^3', Bool(should=(Boost(Phrase(("x", "y"), 2), 3.0),))), ("(a OR b)^2 c", Bool(should=(Boost(Bool(should=(A, B)), 2.0), C))), ("((a) (b c))", Bool(should=(Bool(should=(Bool(should=(A,)), Bool(should=(B, C)))),))),
    ("ab* c?d *", Bool(should=(Prefix("ab"), Wildcard("c?d"), Wildcard("*")))), (r"a\*", Bool(should=(A,))), ("roam~1 roam~ roam~0.8", Bool(should=(Fuzzy("roam", 1), Fuzzy("roam", 2), Fuzzy("roam", 2)))), ("/ab.*/ a", Bool(should=(Regex("ab.*"), A))),
    ("[a TO b] {c TO d} a", Bool(should=(Nothing(), Nothing(), A))), ("1962:700", Bool(should=(Bool(should=(Term("1962"), Term("700"))),))), ("av unga?", Bool(should=(Term("av"), Term("unga")))), ("u?ga", Bool(should=(Wildcard("u?ga"),))),
    ("ANDY or NOTE", Bool(should=(Term("andy"), Term("or"), Term("note")))), ("É*", Bool(should=(Prefix("é"),))), ("foo-bar", Bool(should=(Bool(should=(Term("foo"), Term("bar"))),))), ("... a", Bool(should=(A,))),
])
def test_syntax(typed, want):
    assert P.parse(typed) == want


@pytest.mark.parametrize("typed", ['"never closed', "(a", "a)", "a AND", "AND a", "a ^ b", "a\\", "[a b", "/a", "a ~ b", "^2", "NOT", "", "  ", "?", "*?~^"])
def test_every_text_is_a_query(typed):
    q = simplify(P.parse(typed))
    words = P.plain_analyzer(typed)
    assert isinstance(q, (Bool, Term, Nothing, Wildcard)) and (not words or not isinstance(q, Nothing) or typed == "NOT")


def test_escapes_and_limits():
    assert P.escape_prose(r"a:b \: what?? u?ga \? x?") == r"a\:b \: what\?\? u?ga \? x\?"
    assert simplify(P.parse("-a -b")) == Nothing()
    P.parse("w " * 1000)
    with pytest.raises(QueryTooLong):
        P.parse("w " * 1001)


def test_analyzers_are_those_of_the_index(spark):
    from pyspark.sql import functions as F

    from stackroom.functions.text import folded_tokens, plain_tokens

    texts = ["Ünïcode STRASSE straße", "ﬁne ① 漢字 x_y-z", "", "á É"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(plain_tokens(F.col("t")), folded_tokens(F.col("t"))).collect()
    assert [(list(a), list(b)) for a, b in rows] == [(P.plain_analyzer(t), P.folded_analyzer(t)) for t in texts]


def test_standard_words_on_both_sides(spark):
    from pyspark.sql import functions as F

    from stackroom.functions.text import standard_tokens

    texts = {
        "can't stop: 3.14, 1,000 and example.com": ["can't", "stop", "3.14", "1,000", "and", "example.com"],
        "Café CAFÉ cafe\u0301 Åäö øl Łódź straße İstanbul ﬁne": ["cafe", "cafe", "cafe", "aao", "ol", "lodz", "strasse", "istanbul", "fine"],
        "x_y __ _z a:b 1:2 a.1 1.a 5,a wi-fi": ["x_y", "_z", "a:b", "1", "2", "a", "1", "1", "a", "5", "a", "wi", "fi"],
        "漢字かな カタカナ テスト한국어 ไทย abc漢": ["漢", "字", "か", "な", "カタカナ", "テスト", "한국어", "ไทย", "abc", "漢"],
        "١٢٣ ９ ① ½ 😀 Ⅷ": ["123", "9", "viii"],
        "a\u200bb so\u00adft it’s SFS 2010:800 §": ["a", "b", "soft", "it’s", "sfs", "2010", "800"],
        "": [], "!!! --- \n": [], "a..b 'quoted' end.": ["a", "b", "quoted", "end"],
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", standard_tokens(F.col("t")).alias("w")).collect()
    import unicodedata

    plain = lambda words: [unicodedata.normalize("NFKC", w) for w in words]
    for r in rows:
        if r["t"] is None:
            assert r["w"] is None
        else:
            assert list(r["w"]) == P.standard_analyzer(r["t"]), r["t"]
            assert [w.replace("\u00ad", "") for w in plain(r["w"])] == texts[r["t"]], r["t"]


def test_queries_find_folded_words(spark):
    from stackroom.functions.text import standard_tokens
    from stackroom.operators import search as S

    d = spark.createDataFrame([(1, "Ett Café i Łódź"), (2, "cafeteria"), (3, "can't see example.com"), (4, "version 1,000")], "doc_id int, text string")
    index = S.build_index(d, standard_tokens)
    ask = lambda q: {r["doc_id"] for r in S.compile(P.parse(q, P.standard_analyzer), index).collect()}
    assert ask("CAFE") == {1} and ask("cafe*") == {1, 2} and ask("lodz") == {1} and ask('"CAN\'T see"') == {3} and ask("example.com") == {3} and ask("example") == set() and ask("1,000") == {4}


def test_layout_blocks():
    boxes = [
        ("<h3>Head <b>x</b></h3>", "SectionHeader", 2), ("<p>a</p><ul><li>one<ul><li>in</li></ul></li><li>two</ul>", "ListGroup", 1), ("pre <table><caption>Cap</caption><tr><th>h<td>1<td>2</tr></table> post", "Table", 3),
        ("<math>x^2</math> (3)", "Equation", None), ("<script>bad()</script>plain &amp; text", None, 0), ("", "Picture", 4), ("<pre>x = 1\n  y</pre>", "Code", 5), ("no level", "SectionHeader", 6), ("words", "Form", 7), ("old", "Unknown", 8),
    ]
    pieces, degraded = L.read_layout(boxes)
    assert not degraded and [(p.kind, p.text) for p in pieces] == [
        ("paragraph", "plain & text"), ("paragraph", "a"), ("list_item", "one in"), ("list_item", "two"), ("heading", "Head x"), ("paragraph", "pre"), ("caption", "Cap"), ("table", ""), ("paragraph", "post"), ("code", "x = 1\n  y"), ("heading", "no level"), ("paragraph", "words"), ("paragraph", "old"), ("formula", "x^2"), ("paragraph", "(3)"),
    ]
    assert pieces[7].rows == ((("h", True), ("1", False), ("2", False)),) and [p.level for p in pieces if p.kind == "heading"] == [3, 2]
    pieces, degraded = L.read_layout([("no cells", "Table", 0), ("<h1>t</h1>", "SectionHeader", 1)])
    assert degraded and [(p.kind, p.text) for p in pieces] == [("paragraph", "no cells"), ("paragraph", "t")] and L.read_layout([]) == ([], False)


def test_layout_job(spark):
    d = spark.createDataFrame([(1, [("<h1>A</h1>", "SectionHeader", 1), ("b", "Text", 2)]), (2, None)], "page_id int, layout array<struct<html:string,label:string,reading_order:int>>")
    got = {r["page_id"]: (r["search_text"], [tuple(b) for b in r["blocks"]], r["degraded"]) for r in L.layout_structured(d).collect()}
    assert got == {1: ("A\nb", [("heading", 0, 1, 1, None, None), ("paragraph", 2, 3, None, None, None)], False), 2: ("", [], False)}


def test_spans_boxes_and_figures_without_words(spark):
    assert L.grid([[(2, 1), (1, 2)], [(1, 1), (1, 1)], [(1, 3)]]) == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1), (2, 0, 1, 3)]
    assert L.grid([[(3, 1), (1, 1), (2, 1)], [(1, 1), (1, 1)]]) == [(0, 0, 3, 1), (0, 1, 1, 1), (0, 2, 2, 1), (1, 1, 1, 1), (1, 3, 1, 1)]
    html = '<table><tr><th rowspan="2">a</th><td colspan=" 2 ">b</td></tr><tr><td rowspan="x">c</td><td colspan="0">d</td></tr></table>'
    boxes = [(html, "Table", 1, [0.1, 0.1, 0.9, 0.4]), ("", "Picture", 2, [0.0, 0.5, 1.0, 0.9]), ("", "Picture", 3, None), ("<div>pre <b>bold</b> <p>one</p><section><table><tr><td>x</td></tr></table>in</section> post</div>", "Form", 4, None)]
    d = spark.createDataFrame([(1, boxes)], "page_id int, layout array<struct<html:string,label:string,reading_order:int,box:array<double>>>")
    r = L.layout_structured(d).first()
    table, figure = r["blocks"][0], r["blocks"][1]
    assert [tuple(x) for x in table["spans"]] == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)] and table["box"] == [0.1, 0.1, 0.9, 0.4]
    assert figure["kind"] == "figure" and figure["start"] == figure["end"] and figure["box"] == [0.0, 0.5, 1.0, 0.9]
    assert r["search_text"] == "a\tb\nc\td\npre\nbold\none\nx\nin\npost" and [b["kind"] for b in r["blocks"]] == ["table", "figure", "paragraph", "paragraph", "paragraph", "table", "paragraph", "paragraph"]


def test_many_queries_in_groups_of_bounded_size(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    queries = v.filter("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    for most in (64 << 20, 1000, 1):
        got = {}
        for r in S.nearest_many(v, queries, 4, block=7, most_bytes=most).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        for q, ranks in got.items():
            s = x @ x[q]
            assert [ranks[k] for k in (1, 2, 3, 4)] == sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert len(got) == 30
    assert S.nearest_many(v, queries.limit(0), 4).count() == 0


def test_a_written_index_is_asked_like_texts(spark):
    from stackroom.plans.query import compile

    texts = ["apache license version two", "the apache web server", "license the license", "", None, "no such word"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plan, written = S.build_index(d), S.index_of(d, "six texts")
    assert S.index_of(d, "six texts") is written
    for typed in ("apache license", '+license -web "apache license"', "lic* serv?r~1", "apache AND the"):
        q = P.parse(typed)
        assert sorted((r[0], round(r[1], 9)) for r in compile(q, plan).collect()) == sorted((r[0], round(r[1], 9)) for r in compile(q, written).collect())
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,apache)]" in compile(Term("apache"), written)._jdf.queryExecution().toString()
