import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stackroom.llm import importance as I
from stackroom.session import stored
from tests.llm.fixtures import ALNUM, HARD, docs, prose, words


def runs(text, longest):
    w = words(ALNUM, text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = {}, {}
    for texts, own in (([r[1] for r in rows], s), (target, t)):
        for x in texts:
            for f in runs(x, longest)[0]:
                own[of(f)] = own.get(of(f), 0) + 1
    big, small = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log(((t.get(b, 0) + 1) * (big + buckets)) / ((s.get(b, 0) + 1) * (small + buckets))))
    out = []
    for i, text, *_ in rows:
        found, n = runs(text, longest)
        weight = sum(gain(of(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(*r, ranks.get(id(r))) for r in out], key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = prose(9, 300)
    return [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 5, 19, 20, 21, 60, 300))))) for k in range(n)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 10_000), (3, 64)])
def test_against_brute_force(spark, longest, buckets):
    rows = corpus(300) + HARD + [(1000, "x" * 500 + " " + "Ü" * 200 + " word" * 30)]
    target = [t for _, t in corpus(20, 2)] + [None, ""]
    got = I.resample(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets).collect()
    # rows of one id and text are alike; any of them may have the rank
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, target, longest, buckets)


def test_ranges_blocks_and_runs_do_not_change_the_draw(spark):
    """Many ranges, blocks of few rows, many partitions: the ranks stay those of sorting all rows."""
    rng = random.Random(4)
    rows = [(k, 30, 30, 0, rng.randrange(40)) for k in range(3000)] + [(None, 30, 30, 0, 39)] * 3 + [(7, 30, 30, 0, 39)] * 5 + [(9000 + k, 3, 3, 0, 99) for k in range(50)]
    rng.shuffle(rows)
    scored = stored(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(13))
    want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for percent, range_rows, block in ((10, 50, 4), (37, 100, 1), (100, 1 << 18, 1024), (0, 100, 8), (1, 1, 7)):
        got = I.draw(scored, percent, 20, range_rows, block).collect()
        assert len(got) == len(rows)
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        n = percent * len(want) // 100
        assert [r["rank"] for r in ranked] == list(range(1, n + 1))
        assert [(r["score"], r["doc_id"]) for r in ranked] == [(r[4], r[0]) for r in want[:n]]


def test_tournament_gives_the_least_key_always():
    rng = random.Random(2)
    tree, keys = I.Tournament(), {}
    for _ in range(2000):
        leaf = rng.randrange(37)
        keys[leaf] = (rng.randrange(100), leaf) if rng.random() < 0.8 else I.Tournament.LAST
        tree.put(leaf, keys[leaf])
        assert tree.best()[1] == min(keys.values())


def test_a_run_has_one_block_in_memory():
    """Blocks are only taken from the stream when their first row may be next."""
    taken = []

    def blocks():
        for k in range(50):
            for run in (0, 1):
                taken.append(k)
                yield run, [[2 * k + run], [30], [30], [0], [-(2 * k + run)]]

    out = I.merge(blocks(), 0, 20)
    got = []
    for columns, ranks in out:
        got += list(zip(columns[0], ranks, strict=True))
    assert [i for i, r in got if r is not None] == list(range(20)) and len(got) == 100


def test_no_rows_no_target_no_eligible_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert I.resample(docs(spark, []), none).count() == 0
    rows = [(1, "few words"), (2, None)]
    got = I.resample(docs(spark, rows).withColumns({"rank": F.lit("x"), "score": F.lit(1)}), none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, [])
