"""Query trees, synonyms, ranking and highlighting."""

import math

import pytest
from pyspark.sql import functions as F

from stackroom.operators import search as S
from stackroom.plans import query as Q

T, P, B = Q.Term, Q.Phrase, Q.Bool
DOCS = [(1, "red apple pie"), (2, "green apple tart apple"), (3, "red red wine"), (4, "pie of apple red"), (5, None), (6, "")]


@pytest.fixture(scope="module")
def index(spark):
    return S.build_index(spark.createDataFrame(DOCS, "doc_id int, text string").filter("text IS NOT NULL"))


def found(q, index):
    return {r["doc_id"]: r["score"] for r in Q.compile(q, index).collect()}


def bm25(tf, dl, df, n=5, av=14 / 5):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))


def test_scores(index):
    assert found(T("apple"), index) == pytest.approx({1: bm25(1, 3, 3), 2: bm25(2, 4, 3), 4: bm25(1, 4, 3)})
    both = found(B(should=(T("apple"), T("red"))), index)
    assert both.keys() == {1, 2, 3, 4} and both[1] == pytest.approx(bm25(1, 3, 3) + bm25(1, 3, 3))
    assert found(Q.Boost(T("wine"), 3), index) == pytest.approx({3: 3 * bm25(1, 3, 1)})


@pytest.mark.parametrize(
    "q,ids",
    [
        (B(must=(T("apple"),), must_not=(T("red"),)), {2}), (B(must=(T("apple"), T("red"))), {1, 4}), (B(must_not=(T("red"),)), set()), (B(must=(T("nothing"),), should=(T("red"),)), set()), (P(("red", "apple")), {1}), (P(("apple", "red")), {4}),
        (P(("pie", "apple")), set()), (P(("pie", "apple"), 1), {4}), (P(("red", "red")), {3}), (P(()), set()), (Q.Prefix("gre"), {2}), (Q.Wildcard("t?rt"), {2}), (Q.Wildcard("*in*"), {3}), (Q.Regex("p.e|wine"), {1, 3, 4}), (Q.Fuzzy("appel", 2), {1, 2, 4}),
        (Q.Fuzzy("win", 1), {3}), (Q.TermSet(("tart", "wine")), {2, 3}), (Q.Everything(), {1, 2, 3, 4, 6}), (Q.Nothing(), set()), (B(should=(T("wine"), B(must=(T("green"), T("tart"))))), {2, 3}), (B(must=(T("pie"),), filters=(T("red"),)), {1, 4}),
        (B(must=(T("pie"), T("pie"))), {1, 4}), (Q.Wildcard(r"app\*"), set()),
    ],
)
def test_matches(index, q, ids):
    assert found(q, index).keys() == ids


def test_constant_scores(index):
    assert set(found(Q.Prefix("p"), index).values()) == {1.0} and found(B(filters=(T("wine"),)), index) == {3: 0.0}


def test_simplify():
    assert Q.simplify(P(("a",))) == T("a") and Q.simplify(B(should=(T("a"), Q.Nothing()))) == T("a") and Q.simplify(B(must=(Q.Nothing(), T("a")))) == Q.Nothing() and Q.simplify(B(must_not=(T("a"),))) == Q.Nothing()
    assert Q.clause_count(B(must=(P(("a", "b")),), should=(T("c"), Q.Prefix("d")))) == 4
    with pytest.raises(Q.QueryTooLong):
        Q.compile(B(should=tuple(T(str(k)) for k in range(1001))), None)


GLOSSARY = Q.Glossary([Q.Synonyms.of(["car", "motor vehicle", "auto*"], str.split), Q.Synonyms.of(["big", "large"], str.split)])


def test_glossary_hits():
    hits = lambda s: [(a, b, " ".join(t.tokens)) for a, b, t, _ in GLOSSARY.hits(s.split())]
    assert hits("big motor vehicle") == [(0, 1, "big"), (1, 3, "motor vehicle")] and hits("automobile motor") == [(0, 1, "auto")] and hits("aut car") == [(1, 2, "car")]


def test_expansion():
    car = [P(("motor", "vehicle")), Q.Prefix("auto")]
    assert Q.expand(B(should=(T("x"), T("car"))), GLOSSARY) == B(should=(T("x"), T("car"), *car))
    assert Q.expand(B(must=(T("car"),)), GLOSSARY) == B(must=(B(should=(T("car"), *car)),))
    assert Q.expand(B(must=(T("motor"), T("vehicle"))), GLOSSARY).must[0].should[0] == B(must=(T("motor"), T("vehicle")))
    assert Q.expand(B(must_not=(T("car"),)), GLOSSARY) == B(must_not=(T("car"),))
    assert Q.expand(P(("big", "car")), GLOSSARY).should == tuple(P(a + b) for a in (("big",), ("large",)) for b in (("car",), ("motor", "vehicle"), ("auto",)))
    # a word found by a prefix brings the prefix itself; groups within what is excluded are expanded, its own words aren't
    assert Q.expand(T("automobile"), GLOSSARY) == B(should=(T("automobile"), T("car"), P(("motor", "vehicle")), Q.Prefix("auto")))
    assert Q.expand(B(should=(T("x"),), must_not=(T("car"), B(should=(T("big"),)))), GLOSSARY).must_not == (T("car"), B(should=(T("big"), T("large"))))
    long = Q.expand(P(("big", "car", "big", "car", "big")), GLOSSARY).should
    assert len(long) == Q.MOST_VARIANTS + 1 and long[0] == P(("big", "car", "big", "car", "big"))
    many = B(should=tuple(T("car") for _ in range(200)))
    assert Q.clause_count(Q.expand(many, GLOSSARY)) <= 200 + Q.MOST_ADDED


@pytest.mark.parametrize("bad", [["one"], ["a", "a"], ["a", "ab*"], ["a", "b c*"], ["a", " ".join("x" * 9)], ["a", "x" * 201], [str(k) for k in range(21)]])
def test_synonym_rules(bad):
    with pytest.raises(ValueError):
        Q.Synonyms.of(bad, str.split)


def test_fusion(spark):
    branch = lambda rows: spark.createDataFrame(rows, "doc_id int, score double")
    got = S.fuse(branch([(1, 9.0), (2, 8.0)]), branch([(2, 0.9), (3, 0.9)])).collect()
    assert [(r["doc_id"], r["matched_by"]) for r in got] == [(2, "both"), (1, "keyword"), (3, "semantic")] and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    assert [r["doc_id"] for r in S.fuse(branch([]), branch([(5, 1.0)])).collect()] == [5]


def test_search_modes_and_gate(spark, index):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    run = lambda q, tokens, **k: [r["doc_id"] for r in S.search(index, q, tokens, v, [1.0, 0.0], **k).collect()]
    assert run(T("green"), ["green"], mode="KEYWORD") == [2] and run(T("zzz"), ["zzz"]) == [] and run(T("zzz"), ["app"], mode="SEMANTIC") == [3, 2] and run(T("zzz"), ["zzz"], need_anchor=False) == [3, 2]
    assert run(T("green"), ["green"])[0] == 2
    only = spark.createDataFrame([(3,)], "doc_id int")
    assert run(T("red"), ["red"], scope=only) == [3]


def test_many_queries_agree_with_one(spark):
    import random

    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame(rows[:5], "query_id long, vector array<float>")
    got = {}
    for r in S.nearest_many(v, q, 4, block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for k, vector in rows[:5]:
        assert got[k] == [r["vec_id"] for r in S.nearest(v, vector, 4).collect()]


def test_written_index_reads_back(spark, index, tmp_path):
    S.write_index(index, str(tmp_path / "i"), 3)
    again = S.read_index(spark, str(tmp_path / "i"))
    assert found(B(should=(T("apple"), P(("red", "apple")))), again) == pytest.approx(found(B(should=(T("apple"), P(("red", "apple")))), index))


def test_highlight(spark):
    assert S.highlighted("a <Red> & reddish Ünder", ["red"]) == "a &lt;<mark>Red</mark>&gt; &amp; <mark>reddish</mark> Ünder"
    assert S.highlighted("Under ÜNDER", ["under"]) == "<mark>Under</mark> <mark>ÜNDER</mark>" and S.highlighted("x", ["y"]) is None
    assert S.highlighted("big red car red", [], [["big", "red"]]) == "<mark>big</mark> <mark>red</mark> car red"
    df = spark.createDataFrame([("red",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(S.highlight(F.col("t"), ["red"])).collect()] == ["<mark>red</mark>", None, None]


def test_identity(spark):
    row = spark.createDataFrame([(1, "m", 64)], "schema int, model string, dimension int")
    S.check_identity(row, {"model": "m", "dimension": 64})
    for bad in ({"model": "n"}, {"dimension": 3}):
        with pytest.raises(S.IndexRebuildRequired):
            S.check_identity(row, bad)


def test_valid_rows(spark):
    rows = spark.createDataFrame([(1, "fine text"), (2, "? 1 ."), (3, "..."), (4, "gone text")], "doc_id int, text string")
    live = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    assert [r["doc_id"] for r in S.valid(rows, live).collect()] == [1, 2] and [r["doc_id"] for r in S.valid(rows, live, True).collect()] == [1]


def test_word_set_pairs_against_all_pairs(spark):
    import random

    from stackroom.operators.neardup import word_set_pairs

    rng = random.Random(4)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 25))]
        rows += [(2 * k, "s", " ".join(base)), (2 * k + 1, "s", " ".join(base[1:] + ["the"]))]
    sets = [(i, set(t.split())) for i, _, t in rows]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) >= 0.9 * max(len(x), len(y))}
    rows += [(None, "s", "w1 w2"), (200, None, "w1 w2")]
    got = word_set_pairs(spark.createDataFrame(rows, "doc_id int, source string, text string"), "source").collect()
    same = {a: {b for b, y in sets if x == y} for a, x in sets}
    assert {(r["a"], r["b"]) for r in got if r["kind"] == "equal"} == {(min(same[b]), b) for b, x in sets if x and min(same[b]) < b}
    near = {(r["a"], r["b"]) for r in got if r["kind"] == "near"}
    assert all(a == min(same[a]) and b == min(same[b]) and dict(sets)[a] != dict(sets)[b] for a, b in near)
    assert {tuple(sorted((x, y))) for a, b in near for x in same[a] for y in same[b]} | {(x, y) for s in same.values() for x in s for y in s if x < y and dict(sets)[x]} == want


def test_a_written_index_follows_its_documents_and_analyzer(spark, tmp_path):
    from stackroom.functions.text import folded_tokens

    write = lambda rows: spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "d"))
    read = lambda: spark.read.parquet(str(tmp_path / "d"))
    write([(1, "Café"), (2, "cafe")])
    plain, folded = S.index_of(read(), "follows"), S.index_of(read(), "follows", folded_tokens)
    assert found(T("cafe"), plain).keys() == {2} and found(T("cafe"), folded).keys() == {1, 2}
    assert S.index_of(read(), "follows") is plain and S.index_of(read(), "follows", folded_tokens) is folded
    write([(3, "cafe au lait"), (4, "no")])
    assert found(T("cafe"), S.index_of(read(), "follows")).keys() == {3}


def test_patterns_ask_the_vocabulary_first(spark, tmp_path, monkeypatch):
    S.write_index(S.build_index(spark.createDataFrame(DOCS[:4], "doc_id int, text string")), str(tmp_path / "i"))
    own = S.read_index(spark, str(tmp_path / "i"))
    for most in (1024, 1):  # beyond the bound the vocabulary is joined
        monkeypatch.setattr(Q, "MOST_EXPANDED", most)
        assert found(Q.Prefix("p"), own).keys() == {1, 4} and found(Q.Fuzzy("appel", 2), own).keys() == {1, 2, 4} and found(Q.Wildcard("*z*"), own) == {}
    monkeypatch.setattr(Q, "MOST_EXPANDED", 1024)
    plan = Q.compile(Q.Wildcard("t?r*"), own)._jdf.queryExecution().toString()
    assert "RLIKE" not in plan and "term,tart" in plan.replace(" ", "")


@pytest.mark.parametrize("clusters", [0, 12])
def test_inverted_lists(spark, tmp_path, clusters):
    import numpy as np

    from stackroom.operators import vectors as V

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(max(clusters, 1), 16)) * (3 if clusters else 0)
    points = [(k, (middle[k % max(clusters, 1)] + rng.normal(size=16)).tolist()) for k in range(1500)] + [(5000, None), (5001, [1.0]), (5002, [0.0] * 16)]
    v = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    V.write_lists(v, str(tmp_path), lists=24)
    own = V.read_lists(spark, str(tmp_path))
    assert own.vectors.count() == 1502 and 1 <= own.probes <= 24
    queries = v.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    r = V.recall(own, queries, 30).agg(F.sum("found"), F.sum("wanted")).first()
    assert r[0] >= 0.9 * r[1] and r[1] == 15 * 30 and (not clusters or own.probes <= 12)
    q = points[7][1]
    ids = lambda df: [(x["vec_id"], x["score"]) for x in df.collect()]
    scope = v.filter("vec_id % 3 = 0").select("vec_id")
    assert ids(V.approximate(own, q, 10, scope=scope)) == ids(S.nearest(v, q, 10, scope=scope))  # small: exact
    assert "list IN" not in V.approximate(own, q, 10, scope=scope)._jdf.queryExecution().toString()
    every = V.approximate(own, q, 10, probes=1)
    assert len(ids(every)) == 10 and "PartitionFilters: [" in every._jdf.queryExecution().toString()
    assert ids(V.approximate(own, q, 10, probes=24)) == ids(S.nearest(v.filter("vec_id < 5000"), q, 10))
    assert len(ids(V.approximate(own, q, 400, probes=1))) == 400  # goes on until there are enough


def test_a_scope_of_any_size_is_exact_where_wanted(spark, tmp_path):
    import numpy as np

    from stackroom.operators import vectors as V

    rng = np.random.default_rng(5)
    points = [(k, rng.normal(size=8).tolist(), k % 2) for k in range(3000)]
    v = spark.createDataFrame(points, "vec_id long, embedding array<float>, label int")
    V.write_lists(v, str(tmp_path), lists=24)
    own, q = V.read_lists(spark, str(tmp_path)), points[7][1]
    ids = lambda df: [(x["vec_id"], x["score"]) for x in df.collect()]
    scope = v.filter("label = 1").select("vec_id")
    assert scope.count() > V.EXACT
    assert ids(V.approximate(own, q, 10, probes=1, scope=scope, exact=None)) == ids(S.nearest(v, q, 10, scope=scope)) != ids(V.approximate(own, q, 10, probes=1, scope=scope))


def test_postings_of_rows_are_those_of_a_grouping(spark, tmp_path):
    rows = [(1, "a b a"), (2, ""), (3, None), (4, "b c b b"), (5, "c")]
    for more, one in (([], True), ([(1, "a b a"), (4, "x b")], False)):  # repeated ids
        own = S.build_index(spark.createDataFrame(rows + more, "doc_id int, text string").repartition(3))
        assert own.repeated is not one
        S.write_index(own, str(tmp_path / "i"))
        again = S.read_index(spark, str(tmp_path / "i"))
        plain = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
        names = ["term", "doc_id", "dl", "tf", "positions"]
        assert plain(again.postings().select(names)) == plain(own.postings().select(names)) != []
        assert plain(again.documents) == plain(own.documents)
        assert plain(S.statistics(own)) == plain(S.statistics(again)) == plain(own.postings().groupBy("term").agg(F.count("*"), F.sum("tf")))


def test_many_queries_in_small_parts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(k, (rng.integers(-2, 3, 6) / 2).tolist()) for k in range(90)]  # with ties
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    q = spark.createDataFrame(rows[:7], "query_id long, vector array<float>")
    ask = lambda: sorted(tuple(r) for r in S.nearest_many(v, q, 4).select("query_id", "rank", "vec_id").collect())
    whole = ask()
    monkeypatch.setattr(S, "CELLS", 20)
    assert ask() == whole and len(whole) == 28


def test_only_likely_pairs_of_word_sets_are_verified(spark, monkeypatch):
    from stackroom.operators import neardup

    common = [f"c{k}" for k in range(60)]
    rows = [(k, "s", " ".join([*common[: 30 + k % 30], *(f"u{k}x{i}" for i in range(30))])) for k in range(40)]
    rows += [(100 + k, "s", " ".join([*common, f"v{k}"])) for k in range(4)]  # near each other
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    ask = lambda: sorted(tuple(r) for r in neardup.word_set_pairs(docs, "source").collect())
    want = [(100 + i, 100 + j, "near") for i in range(4) for j in range(i + 1, 4)]
    assert ask() == want
    monkeypatch.setattr(neardup, "MOST_FREQUENT", 3)  # any order of words gives the same pairs
    assert ask() == want


def test_queries_meet_their_lists_without_pairs_as_rows(spark, tmp_path):
    """The approximate search of many queries gives the best of the lists that each probes, by dot product and key, and joins nothing."""
    import numpy as np

    from stackroom.operators import vectors as V

    rng = np.random.default_rng(6)
    points = rng.normal(size=(600, 8)).astype(np.float32)
    points[300:] = points[:300]  # ties
    v = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(600, [1.0] * 5), (601, None)], "vec_id long, embedding array<float>")
    V.write_lists(v, str(tmp_path), lists=11)
    own = V.read_lists(spark, str(tmp_path))
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    place = {r["vec_id"]: r["list"] for r in own.vectors.collect()}
    for probes in (1, 4, 11):
        found = V.approximate_many(own, queries, 7, probes)
        assert "Join" not in found._jdf.queryExecution().toString()
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in range(0, 600, 50):
            lists = set(own.order(points[q])[:probes])
            dots = points @ points[q]
            want = sorted((k for k in range(600) if place[k] in lists), key=lambda k: (-dots[k], k))[:7]
            assert len(got[q]) == len(want) and np.allclose(dots[got[q]], dots[want], atol=1e-5)


def test_the_best_rows_are_kept_whatever_the_parts(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    scores = rng.integers(0, 6, (5, 400)).astype(np.float32)  # many ties
    keys = rng.permutation(400)
    for size in (1, 3, 50, 400):
        best = S._Best(5, 9)
        for at in range(0, 400, size):
            best.add(np.array([0, 1, 2, 3, 4]), scores[:, at : at + size], keys[at : at + size])
        for q in range(5):
            assert best.keys[q].tolist() == keys[np.lexsort((keys, -scores[q]))[:9]].tolist()
    few = S._Best(2, 3)
    few.add(np.array([1]), np.full((1, 2), -np.inf, np.float32), np.array([4, 3]))
    assert few.seen.tolist() == [0, 2] and few.keys[1][:2].tolist() == [3, 4]


def test_packed_word_sets_read_back():
    import numpy as np
    import pyarrow as pa

    from stackroom.operators import neardup as N

    class Sent:
        value = None

    rng = np.random.default_rng(8)
    names = ["b", "scope", "f", "g", "words"]
    for most in (0, 3, 900):
        frequent = np.unique(rng.integers(-(2**62), 2**62, most))
        where = rng.permutation(len(frequent)) + 1 + (1 << 15) * (most == 900)  # gaps of one to three bytes
        Sent.value = (frequent, where)
        sets = [np.unique(np.concatenate([rng.choice(frequent, min(k, len(frequent)), False), rng.integers(-(2**62), 2**62, k % 3 + (not len(frequent)))])) for k in (1, 2, 3, 5, 400)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(["s"] * 5), pa.array(range(5), pa.int64()), pa.array(range(5), pa.int64()), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], names=names)
        (got,) = N._pack(Sent)([batch.slice(1)])
        got = got.slice(1)
        places, counts = N._places(got.column("known"))
        other, ends = N._numbers(got.column("other"), np.int64)
        for k, x in enumerate(sets[2:]):
            known = np.isin(x, frequent)
            first = counts[:k].sum()
            assert places[first : first + counts[k]].tolist() == sorted(where[np.searchsorted(frequent, x[known])].tolist())
            assert other[ends[k] : ends[k + 1]].tolist() == x[~known].tolist() and got.column("n")[k].as_py() == len(x)


def test_a_sets_words_are_dealt_out_packed_and_prefixes_once(spark, monkeypatch):
    """Words are dealt out as places, not as hashes of eight bytes each, and both sides of the join on prefixes read one exchange."""
    from stackroom.operators import neardup as N

    given, kept = [], []
    monkeypatch.setattr(N, "stored", lambda df, f=N.stored: given.append(df) or kept.append(f(df)) or kept[-1])
    common = [f"c{k}" for k in range(500)]
    docs = spark.createDataFrame([(k, "s", " ".join([*common, f"x{k}"])) for k in range(12)], "doc_id int, source string, text string")
    near = N.word_set_pairs(docs, "source")
    assert near.count() == 66 and all("array<bigint>" not in dict(d.dtypes).values() for d in kept)
    packed = next(d for d in kept if "known" in d.columns).selectExpr("sum(length(known) + length(other)) / sum(n)").first()[0]
    assert packed < 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        N.word_set_pairs(docs, "source")
        pairs = [d for d in given if d.columns == ["p", "q"]][-1]
        assert pairs.count() == 66 and pairs.collect() and "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_pairs_are_verified_where_their_families_meet(spark, monkeypatch):
    """A set's words go once to a place where it has pairs, not once for each pair; parts of a place and of a batch change nothing."""
    import random

    from stackroom.operators import neardup as N

    rng = random.Random(9)
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(60)]
        rows += [(family * 100 + k, "s" if k % 5 else "t", " ".join([*base[: 60 - k % 3], *(f"x{rng.randrange(30)}" for _ in range(k % 4))])) for k in range(30)]
    sets = {}
    for i, scope, text in rows:
        sets.setdefault((scope, frozenset(text.split())), i)
    own = sorted((i, scope, w) for (scope, w), i in sets.items())
    want = sorted((a, b, "near") for a, s, x in own for b, t, y in own if a < b and s == t and len(x & y) >= 0.9 * max(len(x), len(y)))
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    ask = lambda: sorted(tuple(r) for r in N.word_set_pairs(docs, "source").filter("kind = 'near'").collect())
    assert ask() == want and len(want) > 500
    sent = []
    monkeypatch.setattr(N, "_meet", lambda least, f=N._meet: sent.append(least) or f(least))
    monkeypatch.setattr(N, "MOST_PAIRS", 20)
    monkeypatch.setattr(N, "WORDS", 500)
    assert ask() == want and sent
