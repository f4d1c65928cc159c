"""The index of segments against one built anew, after every batch."""

import os
import random

import pytest

from stackroom.operators import search as S
from stackroom.operators.segments import Segments
from stackroom.plans.query import Bool, Everything, Phrase, Prefix, Term

WORDS = "red green blue apple pie tart wine of the".split()
ASKED = [Bool(should=(Term("apple"), Term("red"))), Bool(must=(Term("pie"),), must_not=(Term("wine"),)), Phrase(("red", "apple")), Prefix("gre"), Everything(), Term("nothing")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, deleted boolean, version long")


def answers(index):
    return [{r["doc_id"]: round(r["score"], 9) for r in S.compile(q, index).collect()} for q in ASKED]


def fresh(spark, state):
    return S.build_index(spark.createDataFrame(list(state.items()), "doc_id long, text string"))


def test_random_batches_give_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(7)
    own, state = Segments(spark, str(tmp_path)), {}
    for batch in range(5):
        rows, ids = [], rng.sample(range(40), 30 if batch == 0 else 6)
        for i in ids:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))
            if rng.random() < 0.3 and batch:
                rows.append((i, None, True, 1))
                state.pop(i, None)
            else:
                rows += [(i, "older text here", False, 0), (i, text, False, 1)]
                state[i] = text
        assert own.apply(frame(spark, rows), batch)
        assert answers(own.index()) == answers(fresh(spark, state)), batch
    n = len(own.segments())
    assert n <= 5
    assert not own.apply(frame(spark, rows), batch) and len(own.segments()) == n  # the same batch again
    own.merge()
    assert len(own.segments()) == 1 and answers(own.index()) == answers(fresh(spark, state))
    own.vacuum()
    assert len(os.listdir(tmp_path / "segments")) == 1 and answers(own.index()) == answers(fresh(spark, state))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_a_small_change_writes_and_reads_little(spark, tmp_path):
    rng = random.Random(3)
    own = Segments(spark, str(tmp_path))
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    own.apply(frame(spark, [(k, text(), False, 0) for k in range(600)]))
    before, names = size(tmp_path / "segments"), set(os.listdir(tmp_path / "segments"))
    own.apply(frame(spark, [(5, text(), False, 0), (9, None, True, 0)]))
    added = set(os.listdir(tmp_path / "segments")) - names
    assert len(own.segments()) == 2 and len(added) == 1 and sum(size(tmp_path / "segments" / x) for x in added) < 0.1 * before
    plan = own._replaced(own.segments()[:1], spark.createDataFrame([(5,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "folder" in plan
    asked = S.compile(Term("w17"), own.index())._jdf.queryExecution().toString()
    assert asked.count("EqualTo(term,w17)") + asked.count("In(term, [w17])") >= 2  # in each segment's scan


def test_odd_batches(spark, tmp_path):
    own = Segments(spark, str(tmp_path))
    assert own.segments() == [] and answers(own.index()) == [{}] * 6
    own.apply(frame(spark, []))
    own.apply(frame(spark, [(1, None, False, 0), (None, "red", False, 0), (2, "red apple", None, 0), (3, None, True, 0)]))
    assert answers(own.index()) == answers(fresh(spark, {1: "", 2: "red apple"}))
    own.apply(frame(spark, [(2, None, True, 0), (1, None, True, 0)]))
    assert answers(own.index()) == [{}] * 6
    own.apply(spark.createDataFrame([(2, "green pie", "x")], "doc_id long, text string, other string"))
    assert answers(own.index()) == answers(fresh(spark, {2: "green pie"}))


def test_an_unfinished_write_is_never_seen(spark, tmp_path):
    own = Segments(spark, str(tmp_path))
    own.apply(frame(spark, [(1, "red", False, 0)]))
    os.makedirs(tmp_path / "manifests" / "0000000009")  # no _SUCCESS in it
    os.makedirs(tmp_path / "segments" / "half")
    assert answers(own.index()) == answers(fresh(spark, {1: "red"}))
    own.vacuum()
    assert os.listdir(tmp_path / "manifests") == ["0000000001"]


def test_a_stream_of_changes(spark, tmp_path):
    from stackroom.streaming import flows

    own = Segments(spark, str(tmp_path / "index"))
    schema = "doc_id long, text string, deleted boolean, version long"
    for k, rows in enumerate(([(1, "red apple", False, 0), (2, "pie", False, 0)], [(2, None, True, 0), (3, "red wine", False, 0)])):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = flows.watch_folder(spark, str(tmp_path / "in" / "*"), schema, per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        stream.writeStream.foreachBatch(flows.keep_index(own)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert answers(own.index()) == answers(fresh(spark, {1: "red apple", 3: "red wine"}))


@pytest.mark.parametrize("batch", [None, 3])
def test_batches_without_numbers_are_all_taken_in(spark, tmp_path, batch):
    own = Segments(spark, str(tmp_path))
    assert own.apply(frame(spark, [(1, "red", False, 0)]), batch) and own.apply(frame(spark, [(2, "red", False, 0)]), None)
    assert S.compile(Term("red"), own.index()).count() == 2
    assert sum(s.n for s in own.segments()) == 2
