import random

import numpy as np

from stackroom.llm import near_dup as N
from stackroom.llm.components import components
from tests.llm.fixtures import HARD, SPACED, docs, prose, words


def shingles(text):
    w = words(SPACED, text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    name = list(range(len(sets)))

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            both = len(p & q)
            if p and q and 100 * both >= percent * (len(p) + len(q) - both):
                name[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        group = [sets[j][0] for j in range(len(sets)) if find(j) == find(k) and sets[j][0] is not None]
        out.append((i, len(s), min(group) if s and group else i))
    return sorted(out, key=repr)


def check(spark, rows, percent=85):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.link(docs(spark, rows), percent=percent).collect()), key=repr)
    assert got == brute(rows, percent)


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        k = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[k] = f"new{rng.randrange(10**6)}"
        else:
            del out[k]
    return out


def test_random_edits_against_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for seed in range(8):
        base = prose(seed, rng.choice((7, 12, 40, 150)))
        for _ in range(8):
            rows.append((n := n + 1, " ".join(edited(rng, base, rng.choice((0, 0, 1, 2, 4)))).title()))
    check(spark, rows)
    check(spark, rows, 80)


def test_smallest_linked_sets_against_brute_force(spark):
    rows = []
    for seed in range(24):
        base = prose(700 + seed, 8 + seed % 3)
        rows += [(10 * seed + 1, " ".join(base)), (10 * seed + 2, " ".join([*base, "added"])), (10 * seed + 3, " ".join(["before", *base]))]
    check(spark, rows, 80)
    check(spark, rows)


def test_hard_texts_chains_and_copies(spark):
    words_ = prose(50, 160)
    chain = [(100 + k, " ".join(words_[k * 3 : k * 3 + 100])) for k in range(12)]  # each is like the next only
    copies = [(500 + k, "one long line that many documents hold as it is") for k in range(60)]
    check(spark, HARD + chain + copies + [(None, chain[0][1]), (700, "ONE long line\tthat many documents hold as it is")])


def test_no_pairs_within_a_large_group(spark):
    base = prose(9, 300)
    rows = [(k, " ".join(base[:297] + [f"tail{k}"])) for k in range(150)]
    d = docs(spark, rows)
    got = {(r["component_id"], r["kept"]) for r in N.link(d).collect()}
    assert got == {(0, True), (0, False)}


def outsiders(n, base=None):
    """n near copies of a text (its tail cut, one word changed), and texts of which half is like it or each other."""
    base = base or prose(9, 400)
    rng = random.Random(5)
    rows = []
    for k in range(n):
        w = base[: 400 - rng.randrange(25)]
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w)))
    for k in range(6):  # the last two are alike
        w = base[:200] + prose(60 + min(k, 4), 180)
        w[7] = f"out{k}"
        rows.append((n + k, " ".join(w)))
    return rows


def test_a_large_group_with_outsiders_against_brute_force(spark):
    check(spark, outsiders(120), 80)
    base = prose(77, 120)
    families = [(1000 * f + k, " ".join((base[:80] + prose(800 + f, 40))[: 120 - k % 3] + [f"end{k}"])) for f in range(3) for k in range(30)]
    check(spark, families, 80)
    check(spark, families + outsiders(40), 85)


def test_pairs_beside_pivots_grow_with_the_group_only(spark, monkeypatch):
    """Four times the members give about four times the pairs to look at, not sixteen times."""
    seen, likely = [], N._likely
    monkeypatch.setattr(N, "_likely", lambda pairs, *a: seen.append(pairs.count()) or likely(pairs, *a))
    for n in (150, 600):
        N.link(docs(spark, outsiders(n)), percent=80)
    assert seen[3] <= 6 * max(seen[1], n)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared in (200, 600, 900):
        pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
        r = [N.registers(x, np.array([0, len(x)])) for x in (a, b)]
        assert abs(N.estimate(*r)[0] - shared / (2000 - shared)) < 0.25


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_keep_first_and_empty(spark):
    d = docs(spark, HARD)
    kept = N.keep_first(d)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, None]))
    assert N.link(d.limit(0)).count() == 0
