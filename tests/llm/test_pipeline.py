import os

import corpus_pipeline
from tidemark.llm import neardup, packing, pii
from tidemark.llm.catalog import QUERIES
from tidemark.llm.tables import stored, table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stored(stage(spark, frame, FOLDER), name)
        assert frame.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    sets = [set(before), *(set(kept[n]) for n, _ in corpus_pipeline.STAGES[:-1])]
    assert all(a >= b for a, b in zip(sets, sets[1:])) and sets[1] < sets[0] and sets[2] < sets[1]
    poor = {r.doc_id for r in table(spark, FOLDER, "labels").where("quality = 0").collect()}
    assert not poor & sets[1]
    # Nothing near, leaked or personal is left.
    assert neardup.near_duplicates(frame).where("not kept").count() == 0
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    assert not any(i in t for t in kept["decontamination"].values() for i in items)
    assert not any(pii.base_spans(t) for t in kept["personal_data"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).collect()
    assert {r.doc_id for r in packed} == sets[-1] and max(r.offset + r.length for r in packed) <= packing.CAPACITY
    assert sorted(corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32").collect()) == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
