import random

import numpy as np

from stackroom.llm import substring_dedup as S
from tests.llm.fixtures import HARD, SPACED, docs, prose, words


def brute_windows(h, width):
    out = []
    for c in range(len(h)):
        l, r = c, c  # noqa: E741
        while l and h[l - 1] > h[c]:
            l -= 1  # noqa: E741
        while r + 1 < len(h) and h[r + 1] >= h[c]:
            r += 1
        if r - l + 1 >= width:
            out.append((c, c - l, r - c))
    return out


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(4)
    for width in (2, 5, 46):
        for _ in range(20):
            sizes = rng.integers(0, 120, 4)
            h = rng.integers(1, rng.choice([5, 10**9]), sizes.sum()).astype(np.uint64)
            rows = np.concatenate([[0], np.cumsum(sizes)])
            want = [(c + rows[k], lo, hi) for k in range(4) for c, lo, hi in brute_windows(h[rows[k] : rows[k + 1]].tolist(), width)]
            assert list(zip(*(x.tolist() for x in S.windows(h, rows, width)), strict=True)) == want


def exact(rows, length=50):
    """Word places of each document in a run of so many words that a document of a smaller id has."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(SPACED, t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if first.setdefault(g, i) != i:
                out.setdefault(i, set()).update(range(k, k + length))
    return out


def test_planted_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    passages = [prose(900 + k, n) for k, n in enumerate((50, 51, 60, 75, 140, 300))]
    rows = []
    for k in range(60):
        body = prose(k, rng.randrange(30, 200))
        for p in rng.sample(passages, rng.choice((0, 0, 1, 2))):
            at = rng.randrange(len(body))
            body = body[:at] + p + body[at:]
        rows.append((k, " ".join(body)))
    want = exact(rows)
    got = S.find_repeats(docs(spark, rows)).collect()
    covered = {}
    for r in got:
        assert r["doc_id"] > r["source_id"] and r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert covered.keys() == want.keys() and all(want[i] <= covered[i] for i in want)
    clean = S.remove_repeats(docs(spark, rows)).collect()
    texts = {r["doc_id"]: r["text"] for r in clean}
    for p in passages:
        assert sum(" ".join(p) in t for t in texts.values()) == 1
    for i, t in rows:
        if i not in covered:
            assert texts[i] == t


def test_edited_passages_are_verified_by_similarity(spark):
    p = prose(70, 200)
    near, far = list(p), list(p)
    for k in (60, 130):
        near[k] = "changed"
    for k in range(0, 200, 12):
        far[k] = f"x{k}"
    rows = [(1, " ".join(prose(1, 40) + p)), (2, " ".join(near + prose(2, 50))), (3, " ".join(prose(3, 50) + far))]
    got = S.find_repeats(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(2, 1)} and sum(r["end_word"] - r["start_word"] for r in got) >= 190


def test_later_leaders_are_met(spark):
    p = prose(80, 120)
    near = [w if k % 20 else f"y{k}" for k, w in enumerate(p)]  # shares most shingles, but no passage
    rows = [(1, " ".join(near)), (2, " ".join(prose(5, 60) + p)), (3, " ".join(p + prose(6, 60)))]
    got = S.find_repeats(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(3, 2)}


def test_passages_under_keys_of_a_frequent_line(spark):
    line = prose(81, 46)  # nearly all of a passage's shingles, so that its minima are the line's
    rows = [(k, " ".join(prose(100 + k, 60) + line + prose(200 + k, 60))) for k in range(20)]
    for k in range(20, 40, 2):
        p = prose(300 + k, 2) + line + prose(400 + k, 2 + k % 3 * 8)
        rows += [(k + j, " ".join(prose(500 + k + j, 60) + p + prose(600 + k + j, 60))) for j in range(2)]
    want = exact(rows)
    assert want.keys() == set(range(21, 40, 2))
    covered = {}
    for r in S.find_repeats(docs(spark, rows)).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert all(want[i] <= covered.get(i, set()) for i in want)


def variants(rng, n, share):
    """n variants of one 60-word passage, each with so many of its words replaced, that are no passages of each other."""
    base = prose(82, 60)
    return [[w if rng.random() < share else f"v{k}x{i}" for i, w in enumerate(base)] for k in range(n)]


def test_families_of_passages_under_the_same_keys(spark):
    rng = random.Random(9)
    rows = []
    for p in variants(rng, 12, 0.9):
        rows += [(0, " ".join(prose(1000 + rng.randrange(10**6), 60) + p + prose(2000 + rng.randrange(10**6), 60))) for _ in range(12)]
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = exact(rows)
    assert len(want) == 132
    covered = {}
    for r in S.find_repeats(docs(spark, rows)).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert all(want[i] <= covered.get(i, set()) for i in want)


def test_most_edited_passages_are_found(spark):
    rng = random.Random(10)
    line, rows, due = prose(83, 30), [], set()
    for k in range(0, 160, 2):
        own = prose(3000 + k, rng.choice((40, 60, 120)))
        at = rng.randrange(len(own))
        p = own[:at] + line + own[at:]
        near = [f"e{k}x{i}" if i % 70 == 35 else w for i, w in enumerate(p)]  # one word in 70: 0.85 or more
        for j, q in enumerate((p, near)):
            rows.append((k + j, " ".join(prose(5000 + k + j, 40) + q + prose(6000 + k + j, 40))))
        due.add((k + 1, k))
    got = {(r["doc_id"], r["source_id"]) for r in S.find_repeats(docs(spark, rows)).collect()}
    assert got <= due and len(got) >= 0.95 * len(due)


def test_candidates_of_very_repetitive_texts():
    """A passage's windows stay in one candidate, however many other diagonals lie between them."""
    import pyarrow as pa

    def candidates(shared):
        flat = pa.StructArray.from_arrays([pa.array([x[k] for x in shared], pa.int32()) for k in range(4)], ["c", "oc", "reach", "oreach"])
        batch = pa.RecordBatch.from_arrays([*(pa.array([k]) for k in (1, 2, 0, 3)), pa.ListArray.from_arrays(pa.array([0, len(shared)], pa.int32()), flat)], names=["doc", "f", "other", "of", "shared"])
        return [tuple(r.values()) for b in S._candidates(50)[0](iter([batch])) for r in b.to_pylist()]

    reach = (40 << 17) | (40 << 3)
    own = [(c, c + 1000, reach | k, reach | k) for k, c in enumerate((100, 150))]
    others = [(c, c + 5000 + 200 * c, reach, reach) for c in range(101, 150)]
    assert len(candidates(own)) == 1 and candidates(own)[0] in candidates(own + others)


def test_hard_texts_copies_and_repeated_words(spark):
    long = " ".join(prose(3, 30_000))
    rows = [*HARD, (20, long), (21, "of " * 300), (22, "Start " + "of " * 200 + "end"), (23, None)]
    d = docs(spark, rows)
    got = {(r["doc_id"], r["source_id"]) for r in S.find_repeats(d).collect()}
    assert got == {(20, 7), (22, 21)}
    kept = S.remove_repeats(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None, 21, 22, 23}
    assert S.find_repeats(d.limit(0)).count() == 0


def test_verify_reports_both_places():
    p = np.arange(1000, 1100, dtype=np.uint32)
    a, b = np.concatenate([np.arange(10, dtype=np.uint32), p]), np.concatenate([p, np.arange(500, 530, dtype=np.uint32)])
    assert S.verify(a, b, -10, 50, 80) == [(10, 110, 0, 100, 1.0)]
    assert S.verify(a[:40], b, -10, 50, 80) == []


def test_families_of_edited_variants(spark):
    """Twelve variants of a passage in ten documents each, near each other (0.81) but for the first, which is like none (0.66): keys of more windows than are all paired."""
    rows, firsts = [], []
    for f in range(4):
        base = prose(1000 + f, 100)
        for d in range(10):
            for v in range(12):
                own = list(base)
                for k in (10, 50, 90) if v == 0 else (15 + 5 * v,):
                    own[k] = f"changed{f}x{v}x{k}"
                if d == 0 and v > 1:
                    firsts.append(len(rows))  # only an edited passage of a smaller id is like this one
                rows.append((len(rows), " ".join(prose(50_000 + len(rows), 60 + len(rows) % 17) + own + prose(90_000 + len(rows), 60))))
    found = {r["doc_id"] for r in S.find_repeats(docs(spark, rows)).select("doc_id").collect()}
    again = [k for k in range(len(rows)) if k % 120 >= 12]
    assert sum(k in found for k in firsts) >= 0.9 * len(firsts) and all(k in found for k in again)
    assert not any(k in found for k in range(len(rows)) if k % 120 in (0, 1))  # the first variant, and the first of those alike


def test_edited_pairs_under_keys_of_many_texts(spark):
    """A line of 46 words is in every text, so that its keys are large; each pair of texts has 64 words around it alike but for one, and no run of 50."""
    line, rows = prose(84, 46), [(0, " ".join(prose(7000, 60) + prose(84, 46) + prose(7001, 60)))]
    for k in range(1, 81, 2):
        before, after = prose(7100 + k, 2), prose(7300 + k, 20)
        for j in range(2):
            rows.append((k + j, " ".join(prose(8000 + k + j, 40) + before + line + [f"e{j}x{k}", *after[1:]] + prose(9000 + k + j, 40))))
    got = {(r["doc_id"], r["source_id"]) for r in S.find_repeats(docs(spark, rows)).collect()}
    assert got == {(k + 1, k) for k in range(1, 81, 2)}


def test_stretches_that_could_be_a_passage():
    """Without a known shingle at either end, at a passage's distance, nothing is looked up; else the rarer end is."""
    own = np.arange(100, 220)
    line = np.arange(140, 182)
    assert not len(S._ends(own, 60, line, np.full(42, 9), 46, 80))
    assert S._ends(own, 60, np.append(line, 187), np.append(np.full(42, 9), 2), 46, 80).tolist() == [187]
    assert not len(S._ends(own, 60, np.append(line, 199), np.append(np.full(42, 9), 2), 46, 80))  # too few between


def test_the_exact_step_gives_what_is_verified_and_not_every_pair(spark, monkeypatch):
    """Eighty near copies of a passage under large keys that are hardly passages of each other: the rows don't grow with the square of the group."""
    rng, rows, made = random.Random(11), [], []
    line, base = prose(85, 40), prose(86, 60)
    for k in range(80):
        around = [w if rng.random() < 0.93 else f"g{k}x{i}" for i, w in enumerate(base)]
        rows.append((k, " ".join(prose(10_000 + k, 60) + around[:30] + line + around[30:] + prose(11_000 + k, 60))))
    exact_step = S._possible
    monkeypatch.setattr(S, "_possible", lambda *a: made.append(exact_step(*a)) or made[-1])
    found = S.find_repeats(docs(spark, rows)).collect()
    assert all(r["doc_id"] > r["source_id"] and r["similarity"] >= 0.8 for r in found)
    assert made[0].count() <= 20 * len(rows)


def test_shingles_that_come_again_count_once():
    rng = np.random.default_rng(5)
    for t in range(400):
        n = int(rng.integers(46, 112))
        at, own = int(rng.integers(0, min(n, 56))), rng.integers(0, rng.choice([5, 20, 60]), n) if t % 2 else rng.permutation(n)
        has = (rng.random((3, 200)) < rng.choice([0.5, 0.8, 0.9]))[:, own]
        want = [len(known) > 0 and len(S._ends(own, at, known, np.ones(len(known), int), 46, 80)) > 0 for known in (np.unique(own[x]) for x in has)]
        assert S._fits_repeated(own, has, at, 46, 80).tolist() == want and (t % 2 or S._fits(has, at, 46, 80).tolist() == want)


def test_windows_with_too_little_of_a_word_said_again_and_again_are_not_verified(monkeypatch):
    """A passage needs its width on both sides: windows with a long run of one shingle meet those with short runs of it, which none is."""
    import pyarrow as pa

    def block(rows):
        return S._Block(pa.array([{"doc_id": d, "f": d, "c": at, "reach": 0, "at": at, "nearby": x} for d, at, x in rows]))

    long = block([(100 + k, 30, [*range(1000 + 20 * k, 1010 + 20 * k), *[7] * 86]) for k in range(30)])
    short = [(k, 20, [*range(5000 + 100 * k, 5010 + 100 * k), *[7] * 39, *range(5010 + 100 * k, 5060 + 100 * k)]) for k in range(30)]
    asked, stretches = [], S._stretches
    monkeypatch.setattr(S, "_stretches", lambda *a: asked.append(a) or stretches(*a))
    assert S._witnesses(long, block(short), 50, 80) == ([], []) and not asked
    w, v = S._witnesses(long, block([*short, (50, 20, [*range(10), *[7] * 60])]), 50, 80)
    assert w == list(range(30)) and v == [30] * 30 and len(asked) == 30


def test_stretches_against_sets():
    """Each stretch's similarity is that of its sets of shingles."""
    rng = np.random.default_rng(6)
    for t in range(300):
        a = rng.integers(0, (3, 20, 5000)[t % 3], 150)
        b = np.where(rng.random(150) < 0.02, 9999, a)[t % 40 :]
        for s, e, os_, oe, sim in S._stretches(a, b, -(t % 40), 50, 80):
            x, y = set(a[s : e - 4].tolist()), set(b[os_ : oe - 4].tolist())
            assert sim == len(x & y) / len(x | y) >= 0.8 and min(e - s, oe - os_) >= 50


def test_a_texts_words_come_with_one_of_its_windows(spark):
    rows = [(1, " ".join(prose(1, 49))), (2, " ".join(prose(2, 50))), (3, " ".join(prose(3, 400))), (4, "of " * 70), (5, None), (3, " ".join(prose(4, 60)))]
    got = S.windows_of(docs(spark, rows).select("doc_id", "text"), 50, 3).filter("n_words is not null").select("doc_id", "n_words").collect()
    assert sorted(map(tuple, got)) == [(2, 50), (3, 60), (3, 400), (4, 70)]
