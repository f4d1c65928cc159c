import hashlib
import random

from pyspark.sql import functions as F

from stackroom.llm import decontam as D
from tests.llm.fixtures import ALNUM, HARD, docs, words


def brute(texts, items, window):
    grams = {}
    for name, t in items:
        w = words(ALNUM, t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    sizes = {len(g) for g in grams}
    out = []
    for t in texts:
        w, hit, found = words(ALNUM, t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def check(spark, texts, items, window=10, **more):
    d = docs(spark, list(enumerate(texts)))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.find_overlaps(d, i, window, **more).collect()}
    for k, (n, hit, found) in enumerate(brute(texts, items, window)):
        r = got[k]
        assert r["n_words"] == n and [x for s in r["spans"] for x in range(s["start"], s["end"])] == hit and r["items"] == found, k


def test_random_words_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcd")
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 2, 3, 5, 9, 12))))) for k in range(2, 9)] + [(20, ""), (21, None), (22, "a B-c")]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "A, b; C?"]
    check(spark, texts, items, 4)
    check(spark, texts, [x for x in items if x[0] != 2 and len((x[1] or "").split()) != 1], 4)
    check(spark, texts, items, 4, most_words=10)


def test_items_longer_than_an_automaton(spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for k, n in enumerate((0, 3, 9, 10, 11, 60, 400))]
    long = items[-1][1].split()
    texts = [" ".join([f"w{rng.randrange(40)}" for _ in range(5)] + long[k : k + n]) for k, n in ((0, 400), (20, 10), (33, 9), (37, 25), (390, 10))] * 2 + [None, "", "w1"]
    for most in (10, 11, 37, 10**6):
        check(spark, texts, items, most_words=most)


def test_hard_texts_and_no_items(spark):
    texts = [t for _, t in HARD]
    check(spark, texts, [(1, "no id"), (2, "one two three four five six seven eight nine ten eleven")])
    check(spark, texts, [])


def test_spans_are_cut_from_the_text_and_columns_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    d = docs(spark, [(1, f"Before it. {item.title()}! After."), (2, item), (3, "clean text"), (4, None)]).withColumn("spans", F.lit("mine"))
    i = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.remove_overlaps(d, i).collect()}
    assert got[1]["text"] == "Before it. ! After." and got[1]["n_chars"] == 19 and got[1]["spans"] == "mine"
    assert 2 not in got and got[3]["text"] == "clean text" and got[4]["text"] is None


def test_query_columns(spark):
    from stackroom.llm.queries import op7_decontam

    r = op7_decontam(spark, "/root/testdata/sf0.001").filter("contaminated").first()
    assert r["n_hit"] >= 10 and r["n_items"] >= 1 and len(r["items_sha256"]) == 64
    assert op7_decontam(spark, "/root/testdata/sf0.001").filter("not contaminated").first()["items_sha256"] == hashlib.sha256(b"").hexdigest()
