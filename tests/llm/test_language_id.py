from pyspark.sql import functions as F

from stackroom.llm import language_id as L
from tests.llm.fixtures import HARD, docs

WORDS = {"en": "the and of this that with house night", "de": "der und die nicht haus über straße nacht", "fr": "le et les maison dans être nuit où"}


def _corpus(spark):
    rows, n = [], 100
    for lang, text in WORDS.items():
        own = text.split()
        for k in range(20):
            rows.append((n, " ".join(own[(k + j) % len(own)] for j in range(12)), lang))
            n += 1
    return docs(spark, rows)


def test_held_out_languages_are_told_apart(spark):
    d = _corpus(spark)
    found = L.identify(d, F.col("doc_id") % 4 != 0).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found)


def test_hard_texts_and_clashing_columns(spark):
    d = _corpus(spark)
    hard = docs(spark, HARD).withColumn("score", F.lit("mine"))
    got = {(r["doc_id"], r["text"]): r for r in L.predict(hard, L.train(d)).collect()}
    for key in ((1, None), (2, ""), (3, " \n\t "), (4, "!!! 123 ...")):
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0
    assert got[(5, "word")]["lang_pred"] in WORDS and len(got) == 10


def test_counts_are_exact(spark):
    import numpy as np

    d = docs(spark, [(1, "ab", "x"), (2, "AB", "x"), (3, "cd", "y"), (4, None, "y"), (5, "zz", None)])
    m = L.train(d, orders=(1,), buckets=1 << 12)
    p = np.exp(m.log_p[:, 0])
    high = np.sort(p)[::-1]
    assert m.languages == ["x", "y"] and np.isclose(high[0], (2 + L.SMOOTHING) / (4 + L.SMOOTHING * 4096), rtol=1e-4) and np.isclose(high[1], high[0])


def plain_counts(text, orders, buckets):
    """An n-gram at a time, as the module's docstring has them."""
    import numpy as np

    from stackroom.llm.arrow_text import mix

    code = [ord(c) if ord(c) >= 128 or "a" <= c <= "z" else 32 for c in text]
    out = {}
    for n in orders:
        for i in range(len(code) - n + 1):
            h = n
            for c in code[i : i + n]:
                h = (h * 0x100000001B3 + c) % (1 << 64)
            key = int(mix(np.array([h], np.uint64))[0]) % buckets
            out[key] = out.get(key, 0) + 1
    return out


def test_sparse_counts_and_scores_against_brute_force(spark):
    import numpy as np

    texts = ["", "a", "ab", "wo rt\n straße \U0001F600", "x" * 50, "the night " * 30, "é" * 7]
    for piece in (3, 8, 64, 1 << 18):
        got = {}
        for text, bucket, n in L._entries(texts, (1, 2, 3), 512, piece):
            for t, k, x in zip(text.tolist(), bucket.tolist(), n.tolist(), strict=True):
                assert (t, k) not in got
                got[t, k] = x
        assert got == {(i, k): n for i, t in enumerate(texts) for k, n in plain_counts(t, (1, 2, 3), 512).items()}
    rng = np.random.default_rng(3)
    m = L.Model(["a", "b", "c"], rng.normal(size=(512, 3)).astype(np.float32), rng.normal(size=3), (1, 2, 3), 512)
    want = [m.prior + sum((n * m.log_p[k].astype(float) for k, n in plain_counts(t, m.orders, 512).items()), np.zeros(3)) for t in texts]
    assert np.allclose(L._totals(m, texts), want)


def test_many_language_values_in_one_task(spark, monkeypatch):
    """Counts that go out from time to time add up to the same."""
    d = docs(spark, [(k, f"some text {k % 7} und mehr", f"l{k % 40:02}") for k in range(400)]).coalesce(1)
    whole = L.train(d, buckets=1024)
    monkeypatch.setattr(L, "MOST_COUNTS", 1024 * 3)
    parts = L.train(d, buckets=1024)
    assert whole.languages == parts.languages and (whole.log_p == parts.log_p).all() and (whole.prior == parts.prior).all()


def test_a_very_long_text_and_many_languages_take_bounded_memory():
    """20 million characters and 2,048 languages, in a process of its own: less than 1 GB with the matrix of 128 MB."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pyarrow as pa
from stackroom.llm import language_id as L
m = L.Model([f"l{k:04}" for k in range(2048)], np.zeros((L.BUCKETS, 2048), np.float32) - 9, np.zeros(2048), L.ORDERS, L.BUCKETS)
texts = ["the night and the house " * 833_334] + ["word"] * 3000
n = sum(len(t) for b, t, l in L._scored(iter([pa.RecordBatch.from_pydict({"text": texts})]), m, "text"))
assert n == 3001
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert int(out) < 1000


def test_more_languages_than_a_matrix_holds(spark):
    from tests.llm.fixtures import prose

    rows = [(100 + k, " ".join(prose(k % 23, 40)), f"x{k % 23:02}") for k in range(92)]
    d = docs(spark, rows + [r for r in HARD if r[0] != 7])
    whole, parts = L.train(d, buckets=4096), L.train(d, buckets=4096, most_cells=4096 * 5)
    assert isinstance(parts, L.Sharded) and [len(x) for x in parts.languages] == [5, 5, 5, 5, 4] and whole.languages == sum(parts.languages, [])
    key = lambda r: (r["doc_id"] or 0, r["text"] or "")
    one, many = (sorted(L.predict(d.withColumn("score", F.lit("mine")), m).collect(), key=key) for m in (whole, parts))
    assert len(one) == len(many) == 102 and one[0].asDict().keys() == many[0].asDict().keys()
    for a, b in zip(one, many, strict=True):
        assert key(a) == key(b) and a["lang_pred"] == b["lang_pred"] and abs(a["score"] - b["score"]) < 1e-6


def test_nothing_to_learn_from(spark):
    empty = docs(spark, [(1, "text here", None)])
    assert [r["lang_pred"] for r in L.identify(empty).collect()] == ["und"]
    assert L.identify(empty.limit(0)).count() == 0


def test_pipeline_filter_keeps_columns(spark):
    d = _corpus(spark).union(docs(spark, [(1, None), (2, "12 34"), (3, "the house")]))
    kept = L.keep_identified(d)
    assert kept.columns == d.columns and {r[0] for r in kept.collect()} == {r[0] for r in d.collect()} - {1, 2}
