"""Text functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from stackroom.functions import text as X
from stackroom.operators import catalog as C
from stackroom.sources.units import search_form


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(column(F.col("x"))).collect()]


def test_normalize(spark):
    cases = ["﻿a\r\nb\rc", "e\u0301", "a\x07b\tc\n", "", None, "x﻿"]
    want = ["a\nb\nc", "é", "ab\tc\n", "", None, "x﻿"]
    assert values(spark, X.normalize, cases) == want and [search_form(c) for c in cases if c is not None] == [w for w in want if w is not None]


def test_searchable_and_meaning(spark):
    cases = ["", "  ", "Â", " Â ", "Âb", "7", "? . !", "漢", None, "x"]
    assert values(spark, X.searchable, cases) == [False, False, False, False, True, True, False, True, False, True]
    cases = ["? 1 . .", "ab", "a\u0301b", "a b", "漢", "カ", "한", "", None, "1 2", "12"]
    assert values(spark, X.carries_meaning, cases) == [False, True, True, False, True, True, True, False, False, False, True]


def test_folding(spark):
    got = values(spark, X.folded_tokens, ["Straße ÉTÉ ﬁn e-post", None, "Ａ①"], "string")
    assert got == [["strasse", "ete", "fin", "e", "post"], None, ["a1"]]


def test_quality_score(spark):
    clean = "Det var en gång en liten katt som bodde under huset nära stora vägen " * 5
    got = values(spark, X.quality_score, [clean, "¤¤¤ §§ ~~ ^^", "", "  ", None, "1234 5678"])
    assert got[0] > 60 and got[1] < 20 and got[2:5] == [None, None, None] and got[5] == 100.0


def test_half_up_rounding(spark):
    assert values(spark, lambda x: X._half_up(x), [2.25, -0.25, 0.05], "double") == [2.3, -0.2, 0.1]


def test_page_policy(spark):
    good = "Det var en gång en liten katt som bodde under huset nära stora vägen " * 5
    rows = [(good, 0.9, True), ("x", 0.0, True), (good, 0.0, False)]
    df = spark.createDataFrame(rows, "t string, c double, r boolean")
    assert [r[0] for r in df.select(X.page_policy(F.col("t"), F.col("c"), F.col("r"), good=60)).collect()] == [False, True, True]


def test_citations_escape_extension(spark):
    assert values(spark, X.citations, ["[S2][S1] x [S2] [S] (S3)", ""]) == [["S2", "S1"], []]
    assert values(spark, lambda x: X.escape_evidence(x, attribute=True), ['<a b="c">&']) == ["&lt;a b=&quot;c&quot;&gt;&amp;"]
    assert values(spark, X.extension, ["A.TXT", ".profile", "a.tar.gz", "none", "x."]) == ["txt", "", "gz", "", ""]


def test_column_letters_agree(spark):
    from stackroom.sources.text import column_letter

    ns = [1, 26, 27, 52, 702, 703, 18278]
    assert values(spark, X.column_letter, ns, "int") == [column_letter(n) for n in ns] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


def test_offset_map(spark):
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((2, 4, "xyz"), (6, 9, ""))])
    assert values(spark, lambda x: X.map_offset(x, edits), [0, 2, 3, 4, 6, 7, 9, 10], "int") == [0, 2, 2, 5, 7, 7, 7, 8]
    assert values(spark, lambda x: X.map_offset(x, edits, end=True), [3, 4, 9], "int") == [5, 5, 7]


IGNORE = [
    (["*.log"], "a/b.log", False, True), (["*.log"], "a/b.LOG", False, True), (["/build"], "build", True, True), (["/build"], "a/build", True, False), (["build/"], "build", False, False), (["build/"], "build/x", False, True),
    (["a/**/z"], "a/z", False, True), (["a/**/z"], "a/b/c/z", False, True), (["**/t?p"], "x/tmp", False, True), (["*.txt", "!keep.txt"], "keep.txt", False, False), (["*.txt", "!keep.txt", "*.txt"], "keep.txt", False, True),
    (["dir/", "!dir/keep"], "dir/keep", False, True), (["# c", "", "x"], "x", False, True), ([r"\!x"], "!x", False, True), (["a/**"], "a", True, False), (["a/**"], "a/b", False, True), ([], "x", False, False), (["a.c"], "abc", False, False),
]


@pytest.mark.parametrize("patterns,path,is_dir,want", IGNORE)
def test_ignore_patterns(spark, patterns, path, is_dir, want):
    assert spark.range(1).select(C.ignored(F.lit(path), F.lit(is_dir), patterns)).first()[0] is want


def test_filter_bounds():
    f = C.Filters(since="2024-02-29", until="2024-03-01", name_contains="  ").normalized()
    assert (f.since, f.until, f.name_contains) == ("2024-02-29T00:00:00.000Z", "2024-03-01T23:59:59.999Z", None)
    f = C.Filters(since="2024-01-01T10:00:00.000400+02:00", until="2024-01-01T10:00:00.000600+00:00").normalized()
    assert (f.since, f.until) == ("2024-01-01T08:00:00.001Z", "2024-01-01T10:00:00.000Z")
    with pytest.raises(ValueError):
        C.Filters(since="2024-01-02", until="2024-01-01").normalized()


def test_criteria(spark):
    from datetime import datetime

    rows = [(1, "c", "text/plain", "a_b.txt", "x/a_b.txt", None, "Ann", "en", "COMPLETE", datetime(2024, 1, 1)), (2, "c", "text/html", "axb.txt", "x/axb.txt", "100% sure", None, "sv", "FAILED", datetime(2024, 2, 1))]
    d = spark.createDataFrame(rows, "doc_id int, collection string, media_type string, filename string, path string, title string, author string, lang string, status string, created_at timestamp")
    ids = lambda **f: [r["doc_id"] for r in C.find_documents(d, C.Filters(**f)).orderBy("doc_id").collect()]
    assert ids(name_contains="A_B") == [1] and ids(about_contains="100%") == [2] and ids(about_contains="SV") == [2] and ids(since="2024-01-15") == [2] and ids(collection="d") == [] and ids() == [1, 2]


def test_no_case_sort(spark):
    from datetime import datetime

    d = spark.createDataFrame([(1, "b", datetime(2024, 1, 1)), (2, "A", datetime(2024, 1, 2)), (3, "a", datetime(2024, 1, 2)), (4, "É", datetime(2024, 1, 3))], "doc_id int, filename string, created_at timestamp")
    order = lambda how: [r["doc_id"] for r in C.sorted_documents(d, how).collect()]
    assert order("NAME_ASC") == [2, 3, 1, 4] and order("NEWEST") == [4, 2, 3, 1] and order("OLDEST") == [1, 2, 3, 4]


def test_redaction_and_upserts(spark):
    df = spark.createDataFrame([({" Password ": "x", "user": "y"},)], "f map<string,string>")
    assert df.select(C.redact(F.col("f"))).first()[0] == {" Password ": "[redacted]", "user": "y"}
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int"), spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in C.keep_last_write(old, new, ["k"], "n").select("k", "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    assert sorted(tuple(r) for r in C.insert_absent(old, new, ["k"]).select("k", "v").collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_page_changes(spark):
    now = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc_id int, ordinal int, sha string")
    then = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 5, "z")], "doc_id int, ordinal int, sha string")
    assert tuple(C.page_changes(now, then).first()) == (1, 1, 1, 1, 1)


def test_column_letters_count_on_beyond_three(spark):
    ns = [18278, 18279, 18278 + 676 * 200]
    assert values(spark, X.column_letter, ns, "int") == ["ZZZ", "[AA", chr(65 + 225) + "ZZ"]


def test_given_scores_weigh_as_computed_ones(spark):
    d = spark.createDataFrame([(1, "good plain words here"), (1, "x1 y2 §§§§"), (2, "  "), (2, None)], "k int, text string")
    ask = lambda score: sorted(tuple(r) for r in d.withColumn("own", X.quality_score(F.col("text"))).groupBy("k").agg(X.mean_quality(F.col("text"), score)).collect())
    assert ask(F.col("own")) == ask(None)


def test_a_documents_units_are_added_in_their_order(spark, tmp_path):
    """The mean of these is exactly half a tenth; by the order of their sum it is 36.9 or 37.0."""
    import itertools

    import duckdb

    from stackroom.queries import text as Q

    lines = ["to licence days licence was to a in read", "read days licence #1 4a in on a of", "days Uppsala 4a xyz a in in days", "a read of seven on"]
    texts = ["\n".join(p) for p in itertools.permutations(lines)] * 20 + [None, "", " \n", "\n".join(lines) + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in Q.document_quality_weighted(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(Q.ORACLE["document_quality_weighted"]).fetchall()) and {s for _, s in got} == {36.9, 37.0, None}
