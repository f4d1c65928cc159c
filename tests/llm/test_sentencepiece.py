import random

import pytest

from stackroom.llm import sentencepiece_nbest as S
from tests.llm.fixtures import HARD, docs, prose

BYTES = [f"<0x{b:02X}>" for b in range(256)]


def tiny():
    names = ["<unk>", *BYTES, "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "bca"]
    scores = [0.0] * 257 + [-1.0, -2.0, -2.5, -2.25, -3.0, -3.5, -4.0, -2.0, -3.25, -3.0, -5.0]
    return S.Pieces.of(names, scores, {0})


def brute(p, word, n):
    out = []

    def back(j, score):
        if not j:
            out.append(score)
        for i in range(j):
            if word[i:j] in p.score:
                back(i, score + p.score[word[i:j]][1])
        if j and word[j - 1] not in p.score:
            back(j - 1, score + p.floor * len(word[j - 1].encode()))

    back(len(word), 0.0)
    return sorted(out, reverse=True)[:n]


def test_nbest_against_all_paths():
    p, rng = tiny(), random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abc▁é") for _ in range(rng.randrange(1, 9)))
        found = p.nbest(word, 5)
        assert [round(s, 9) for s, _ in found] == [round(s, 9) for s in brute(p, word, 5)] and len({i for _, i in found}) == len(found)
        want = brute(p, word, 2)
        gap = p.viterbi(word)[3]
        assert gap == float("inf") if len(want) == 1 else abs(gap - (want[0] - want[1])) < 1e-9


def test_paths_spell_their_word_in_order():
    p, rng = tiny(), random.Random(3)
    for _ in range(50):
        word = "".join(rng.choice("abcé▁") for _ in range(rng.randrange(1, 12)))
        for score, ids in p.nbest(word, 4):
            assert p.decode(ids) == word.replace("▁", " ")[1:]
            named = sum(p.score[p.names[i]][1] for i in ids if p.names[i] in p.score)
            assert abs(score - named - p.floor * sum(i in p.byte for i in ids)) < 1e-6


def test_a_long_word_takes_memory_in_proportion(model):
    import tracemalloc

    word = "▁" + "".join(prose(4, 3_000))
    peaks = []
    for n in (len(word) // 2, len(word)):
        tracemalloc.start()
        assert len(model.nbest(word[:n], 4)) == 4
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2.5 * peaks[0] and peaks[1] < 2_000 * len(word)


def test_many_words_at_once_are_those_one_by_one(model):
    rng = random.Random(5)
    for p in (tiny(), model):
        words = sorted({"▁" * rng.randrange(2) + "".join(rng.choice("abc▁éht\n") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
        assert list(p.best_paths(words)) == [(v[2], v[1], v[3]) for v in map(p.viterbi, words)]


def test_whole_texts_combine_words_exactly():
    p = tiny()
    for text in ("ab cab", "abc abc b", "a"):
        lattice = "▁" + text.replace(" ", "▁")
        ws = p.words(text)
        assert "".join(ws) == lattice
        v = [p.viterbi(w) for w in ws]
        got = S.combine(sum(x[1] for x in v), [x[3] for x in v], lambda k: p.nbest(ws[k], 4), 4)  # noqa: B023
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s in brute(p, lattice, 4)]


@pytest.fixture(scope="module")
def model():
    return S.Pieces.read()


def test_round_trip_of_hard_texts(spark, model):
    rows = [(k, t) for k, (_, t) in enumerate(HARD)] + [(50, "  lead and  gaps \n\n tabs\t"), (51, "﷽ ½ 日本語 \U0001F9D1‍\U0001F4BB"), (52, " ".join(prose(1, 50)))]
    encoded = S.encode(docs(spark, rows), model)
    for r in S.decode(encoded, model).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["round_trip"] and r["decoded"] == (text or "") and r["n_pieces"] == len(r["ids"]) and list(r["scores"]) == sorted(r["scores"], reverse=True)


def test_words_decide_alone(model):
    text = "The quick  brown fox\njumps"
    whole = model.nbest("▁" + text.replace(" ", "▁"), 1)[0]
    parts = [model.nbest(w, 1)[0] for w in model.words(text)]
    assert abs(whole[0] - sum(s for s, _ in parts)) < 1e-6


def test_models_whose_pieces_hold_blanks_are_searched_whole():
    p = S.Pieces.of(["<unk>", *BYTES, "a", "a▁b", "▁", "b"], [0.0] * 257 + [-2.0, -1.0, -3.0, -2.0], {0})
    assert p.words("a b") == ["▁a▁b"] and p.decode(p.nbest("▁a▁b", 1)[0][1]) == "a b"


def test_extra_columns_and_empty_tables(spark, model):
    from pyspark.sql import functions as F

    d = docs(spark, [(1, "x")]).withColumn("ids", F.lit("mine"))
    assert S.encode(d, model).first()["ids"] == [model.score["▁x"][0]] and S.encode(d.limit(0), model).count() == 0
