import hashlib

from pyspark.sql import functions as F

from stackroom.llm import fill_in_middle as M
from tests.llm.fixtures import HARD, docs, prose


def brute(doc_id, text, rate=90, spm=20):
    """The contract, code point by code point."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows):
    got = M.restore(M.arrange(docs(spark, rows))).collect()
    want = {i: brute(*r[:2]) for i, r in enumerate(rows)}
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == sorted((str(rows[i][0]), *w) for i, w in want.items())
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t, *_ in rows)
    return got


def test_hard_cases(spark):
    check(spark, HARD)


def test_every_cut_around_the_runs(spark):
    """Texts of about one, two and three runs of units, with many ids: cuts fall before, on and after the borders of runs."""
    texts = [("ab\U0001F600é\n" * 200)[:n] for n in (1, 2, 255, 256, 257, 511, 512, 513, 768, 770)]
    got = check(spark, [(100 * k + j, t) for k in range(40) for j, t in enumerate(texts)])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_sentinels_in_a_text_leave_it_plain(spark):
    rows = [(k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M>", "<P", "P>", "< P>", "<p>", "<<P>>"])]
    forms = {r["doc_id"]: r["form"] for r in check(spark, rows)}
    assert all(forms[k] == "plain" for k in (0, 1, 2, 7))


def test_other_units(spark):
    text = "one two\n\nthree  four\nfive " * 120
    for unit in (M.WORD, M.LINE):
        rows = M.restore(M.arrange(docs(spark, [(k, text) for k in range(30)]), unit=unit)).collect()
        assert all(r["restored"] == text for r in rows)
        assert {r["n"] for r in rows} == {600 + 1 if unit == M.WORD else 361}
        for r in rows:  # cuts stand at the units' borders
            if r["form"] != "plain" and unit == M.LINE:
                assert text[: r["prefix_chars"]][-1:] in ("\n", "")


def test_columns_of_clashing_names_and_an_empty_table(spark):
    own = docs(spark, [(1, "some text"), (2, None)]).withColumns({"n": F.lit("x"), "Output": F.lit("y"), "_fim": F.lit("z"), "a.b": F.lit(1)})
    got = M.arrange(own)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_fim", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.count() == 2 and M.restore(M.arrange(own.limit(0))).count() == 0


def test_long_text_and_no_python(spark):
    plan = M.restore(M.arrange(docs(spark, HARD)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    text = " ".join(prose(5, 200_000))
    check(spark, [(k, text) for k in (1, 2, 3)])
