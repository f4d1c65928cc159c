from stackroom.llm import license_scan as L
from tests.llm.fixtures import ALNUM, HARD, docs, prose, words


def test_base_columns_against_brute_force(spark):
    filler = " ".join(prose(1, 30))
    texts = [t for _, t in HARD] + [
        f"{filler} Released under the MIT License. {filler} under the mit license", "Apache License, Version 2.0", "cc by nc", "CC-BY-NC 4.0 and CC BY NC", "cc by", "under the MIT", "mit license under the", "under the under the mit license x",
    ]
    d = docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in L.scan(d).collect()}
    for k, t in enumerate(texts):
        w, at, labels = words(ALNUM, t), [], set()
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_the_method_finds_other_notices_and_leaves_others_alone(spark):
    filler = " ".join(prose(2, 60))
    texts = {
        1: f"{filler}\nThis work is licensed under the GNU General Public License, version 3.\n{filler}",
        2: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        3: f"{filler} general public version 3 license gnu the under {filler}",
        4: "the license of this work is general",
        5: "This work is licenced under the terms of the GNU General Public License in its version 3",
    }
    got = {r["doc_id"]: r for r in L.scan(docs(spark, list(texts.items()))).collect()}
    assert got[1]["labels"] == "gpl-3" and got[1]["score"] == 1 and got[2]["labels"] == "bsd"
    assert got[3]["labels"] == "" and got[4]["labels"] == "" and got[4]["score"] == 0


def test_places_are_found_by_relative_position():
    index = L.build_index([("x", "one two three four five", ["three four"])], {})
    index.idf = [1.0] * len(index.words)
    ids = {w.decode(): i for i, w in enumerate(index.words)}
    file = [-1] * 7 + [ids[w] for w in "one two three four five".split()] + [-1] * 3
    assert L.look_up(index, file) == {"x": 1.0}
    assert L.look_up(index, file[::-1]) == {}


def test_empty_table(spark):
    assert L.scan(docs(spark, [(1, "x")]).limit(0)).count() == 0
