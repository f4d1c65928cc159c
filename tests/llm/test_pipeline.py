import json
import os

import corpus_pipeline as P
from tests.llm.fixtures import ALNUM, SPACED, docs, prose, words


def test_stages_take_effect_one_after_another(spark, tmp_path):
    item = " ".join(prose(300, 20))
    shared = prose(301, 80)
    base = prose(302, 120)
    rows = [(k, " ".join(prose(k, 90)), "en") for k in range(30)] + [
        (100, None, "en"), (101, "123 456", "en"), (102, " ".join(base), "en"), (103, " ".join(base[:119] + ["other"]), "en"), (104, " ".join(prose(400, 60) + shared), "en"), (105, " ".join(shared + prose(401, 60)), "en"),
        (106, " ".join(prose(402, 70)) + " " + item.upper(), "en"), (107, item, "en"),
    ]
    d = docs(spark, rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, step, str(tmp_path))
        if k < 4:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r for r in step.collect()})
    assert kept[0].keys() == {r[0] for r in rows} - {100, 101}
    assert kept[1].keys() == kept[0].keys() - {103}
    assert kept[2].keys() == kept[1].keys() and " ".join(shared) not in kept[2][105]["text"] and kept[2][104]["text"] == rows[34][1]
    assert kept[3].keys() == kept[2].keys() - {107} and len(words(ALNUM, kept[3][106]["text"])) == 70 and kept[3][106]["n_chars"] == len(kept[3][106]["text"])
    assert kept[4].keys() == kept[3].keys() and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in kept[4].values())
    whole = {r["doc_id"]: r["ids_sha256"] for r in P.run(spark, str(tmp_path)).collect()}
    assert whole == {k: r["ids_sha256"] for k, r in kept[4].items()}


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs(spark, [(1, "x")]).limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, step, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        step = spark.read.parquet(str(tmp_path / str(k)))
    assert step.count() == 0 and os.listdir(tmp_path) and json.dumps(step.columns) and SPACED
