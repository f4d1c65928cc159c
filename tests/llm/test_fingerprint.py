import hashlib
import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from stackroom.llm import fingerprint as G
from tests.llm.fixtures import HARD, SPACED, docs, prose


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(x, seed=42):
    """Spark's xxhash64 of a text or a long."""
    data = x.encode() if isinstance(x, str) else (x & (1 << 64) - 1).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def numbers(word, n, samples=G.SAMPLES):
    """A word's number for each sample."""
    out = []
    for j in range(samples):
        h = [xxhash.xxh64_intdigest((2 * j + i).to_bytes(4, "little"), spark_hash(signed(spark_hash(word)))) for i in (0, 1)]
        share = lambda x, low, bits: ((x >> low & (1 << bits) - 1) + 0.5) / (1 << bits)
        c = -math.log(share(h[0], 32, 32) * share(h[0], 0, 32))
        r, b = -math.log(share(h[1], 42, 22) * share(h[1], 20, 22)), share(h[1], 0, 20)
        out.append(math.log(c) - r * (math.floor(math.log(n) / r + b) + 1 - b))
    return out


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values())


def test_fingerprints_against_brute_force(spark):
    """Words' numbers, but for their last bits, are those of the formula; a fingerprint names the smallest of its text's words."""
    rows = [(1, "a b b c c c"), (2, "A b B  c\nc c"), (3, "one"), (4, " ".join(prose(2, 60) * 3)), *[(10 + k, t) for k, (_, t) in enumerate(HARD) if k != 6]]
    counts = {i: Counter(SPACED.findall((t or "").lower())) for i, t in rows}
    pairs = sorted({p for c in counts.values() for p in c.items()})
    v = G._samples(F.xxhash64("word"), F.col("n"), G.SAMPLES)
    found = {(r["word"], r["n"]): r["v"] for r in spark.createDataFrame(pairs, "word string, n long").select("word", "n", v.alias("v")).collect()}
    assert all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for p in pairs for x, y in zip(found[p], numbers(*p), strict=True))
    least = [(i, [min(found[p][j] for p in c.items()) for j in range(G.SAMPLES)] if c else []) for i, c in counts.items()]
    digits = F.array_join(F.transform("v", lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND(0xFFFF)), 4, "0")), "")
    want = {r["doc_id"]: r["f"] for r in spark.createDataFrame(least, "doc_id long, v array<double>").select("doc_id", digits.alias("f")).collect()}
    got = {r["doc_id"]: r["fingerprint"] for r in G.fingerprints(docs(spark, rows)).collect()}
    assert got == want and got[1] == got[2] and len(got[1]) == 4 * G.SAMPLES and got[11] == ""


def test_likeness_is_the_generalised_jaccard_similarity(spark):
    """Over a thousand samples the share of equal ones is within four standard deviations of the similarity."""
    w = prose(1, 80)
    texts = [" ".join(w[:40]), " ".join(w[:40] + w[:10] * 3), " ".join(w[20:60]), " ".join(w[:40] * 5), " ".join(w[40:])]
    got = [r["fingerprint"] for r in G.fingerprints(docs(spark, list(enumerate(texts))), samples=1024).orderBy("doc_id").collect()]
    pairs = [(i, j) for i in range(5) for j in range(i)]
    near = spark.createDataFrame([(i, j, got[i], got[j]) for i, j in pairs], "i int, j int, a string, b string").select("i", "j", G.likeness(F.col("a"), F.col("b")).alias("x"))
    for r in near.collect():
        p = jaccard(texts[r["i"]], texts[r["j"]])
        assert abs(r["x"] - p) <= 4 * math.sqrt(p * (1 - p) / 1024) + 1e-3


def compared(rows):
    """The edited text of each row, in the order of ids; rows of one id in any order."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest(), text == after)
    return out


@pytest.mark.parametrize("rows", [[(k * k * 977 % 100_003, " ".join(prose(k, k % 17))) for k in range(200)], [(1, "alone here")], [(-5, "x y"), (10**17, "z z"), (3, None)], [(k, "same text all over") for k in range(40)]], ids=["many", "one", "far apart", "copies"])
def test_neighbours(spark, rows):
    got = G.compare(docs(spark, rows)).collect()
    want = compared(rows)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == {k: v[:2] for k, v in want.items()} and len(got) == len(rows)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and (not want[r["doc_id"]][2] or r["near_next"] == 1)


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    """Whatever stands at the cut: a word's middle, white space, nothing but white space, no word at all."""
    rows = [(k, t) for k, t in enumerate(["ab cd", "ab  cd ", "a", "", "  \n x", "xx yy zz \t", "one two one two", "abcdef", " ", "é\u2028 \U0001F600 ü", *[" ".join(prose(k, k)) for k in range(30)], "same same", "same same"])]
    texts = {}
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        texts[i] = text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]
    want = {r["doc_id"]: r["fingerprint"] for r in G.fingerprints(docs(spark, list(texts.items()))).collect()}
    own = {r["doc_id"]: r["fingerprint"] for r in G.fingerprints(docs(spark, rows)).collect()}
    got = G.compare(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["edited_fingerprint"] for r in got} == want and {r["doc_id"]: r["fingerprint"] for r in got} == own
    for r in got:
        after = own[(r["doc_id"] + 1) % len(rows)]
        same = [r["fingerprint"][j : j + 4] == after[j : j + 4] for j in range(0, 256, 4)] if after and r["fingerprint"] else [after == r["fingerprint"]]
        assert r["near_next"] == sum(same) / len(same)


def test_hard_cases_repeated_and_null_ids(spark):
    got = G.compare(docs(spark, HARD)).collect()
    assert len(got) == len(HARD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == "" and by_id[1]["near_next"] == 1
    assert by_id[8]["fingerprint"] == by_id[9]["fingerprint"] and by_id[4]["near_next"] == 0
    # the null id is the last one: after id 9 comes it, and after it the first
    assert by_id[9]["edited_sha256"] == hashlib.sha256(b"same teno id").hexdigest() and by_id[None]["edited_sha256"] == hashlib.sha256(b"no ").hexdigest()
    assert G.compare(docs(spark, [])).count() == 0 and G.fingerprints(docs(spark, [])).count() == 0


def test_only_functions_and_one_shuffle_of_texts(spark):
    plan = G.compare(docs(spark, HARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    own = docs(spark, HARD).withColumns({"fingerprint": F.lit(1), "row": F.lit(2), "bucket": F.lit(3), "a.b": F.lit(4)})
    assert G.fingerprints(own).columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "bucket", "a.b", "fingerprint"]
