import collections
import random

import numpy as np
from pyspark.sql import functions as F

from stackroom.llm import quality_classifier as M
from stackroom.llm import quality_rules as Q
from stackroom.llm.queries import op9_quality_classifier
from tests.llm.fixtures import HARD, SPACED, docs, prose


def brute(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(6)
    texts = [t for _, t in HARD] + [" ".join(rng.choice("ab c\nd | # x".split(" ")) for _ in range(rng.randrange(60))) for _ in range(80)] + ["a\na\n\na\r\na", "a\u00a0b \u2003c", "a b c a b c", "a b c a b", "x x x x"]
    d = docs(spark, list(enumerate(texts)))
    for r in Q.measure(d).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_poor_documents_are_told_from_good_ones(spark):
    rng = random.Random(1)
    good = [(k, " ".join(prose(k, rng.randrange(60, 300)))) for k in range(120)]
    poor = [(1000 + k, " ".join(w + rng.choice(["$$$", "%%%", "***"]) for w in prose(k, 120))) for k in range(10)] + [(2000 + k, " | ".join(prose(k, 100))) for k in range(10)]
    short = [(3000, "too short"), (3001, "a b c " * 40), (3002, None)]
    got = {r["doc_id"]: r for r in Q.judge(docs(spark, good + poor + short)).collect()}
    assert all(got[k]["kept"] for k, _ in good) and not any(got[k]["kept"] for k, _ in poor + short)
    assert [got[k]["base_failed"] for k, _ in short] == [True] * 3


def test_estimates_find_the_rules_rates():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    votes = collections.Counter()
    for g in good:
        votes[tuple(None if rng.random() < 0.3 else bool(rng.random() < (0.95 if g else 0.2)) for _ in range(4))] += 1
    prior, weights = Q.estimate(sorted(votes.items(), key=repr))
    assert abs(prior - 0.7) < 0.03 and all(abs(w[0] - np.log(0.95 / 0.2)) < 0.2 and abs(w[1] - np.log(0.05 / 0.8)) < 0.3 for w in weights)


def test_rules_of_empty_and_hard_tables(spark):
    d = docs(spark, HARD).withColumn("kept", F.lit("mine"))
    assert Q.judge(d).count() == len(HARD) and Q.judge(d.limit(0)).count() == 0


def test_no_python_in_the_rules_plan(spark):
    plan = Q.judge(docs(spark, HARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _bags(rng, n):
    x, rows, y = [], [0], []
    for _ in range(n):
        k = rng.integers(1, 6)
        bag = rng.normal(size=(k, M.WIDTH)).astype(np.float32)
        label = rng.random() < 0.5
        if not label:
            bag[rng.integers(k), :3] += 4  # one passage decides
        x.append(bag)
        rows.append(rows[-1] + k)
        y.append(float(label))
    return np.concatenate(x), np.array(rows), np.array(y, np.float32)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    x, rows, y = _bags(rng, 5)
    w = {k: v.astype(np.float64) for k, v in M.fit(x, rows, y).weights.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, M._forward(w, x, rows)["logit"]) - y * M._forward(w, x, rows)["logit"]))
    for k, g in M._gradient(w, x, rows, y).items():
        at = tuple(int(rng.integers(s)) for s in w[k].shape)
        old = w[k][at]
        w[k][at] = old + 1e-5
        up = loss()
        w[k][at] = old - 1e-5
        down = loss()
        w[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_attention_learns_from_bag_labels():
    rng = np.random.default_rng(3)
    m = M.fit(*_bags(rng, 400))
    x, rows, y = _bags(rng, 200)
    assert ((m.score(x, rows) >= 0.5) == (y > 0)).mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op9_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95


def test_classifier_of_hard_and_empty_tables(spark):
    d = docs(spark, HARD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in M.predict(d, M.train(d, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (7, 1), (1, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = M.predict(d.withColumn("score", F.lit("x")), M.train(d, labels)).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    assert M.predict(d.limit(0), M.train(d, labels)).count() == 0
