"""The pipeline's sequences follow the mix of sources."""

from collections import defaultdict

import corpus_pipeline as C
from pairloom.llm import mixing as M
from pairloom.llm import packing as P
from tests.llm.test_packing import PATH, check

SF = "/root/testdata/sf0.001"


def by_stretch(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.sequence_id >> 32].add(r.doc_id)
    assert sorted(out) == list(range(len(out)))
    return [out[k] for k in sorted(out)]


def test_run(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 16)
    found = by_stretch(C.run(spark, SF).collect())
    kept = set().union(*found)
    assert len(found) > 2 and sum(map(len, found)) == len(kept)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").where("doc_id in (%s)" % ",".join(map(str, kept)))
    mix = [r.doc_id for r in M.mixed(docs).sort("slot", "place").collect()]
    assert [set(mix[k : k + 16]) for k in range(0, len(mix), 16)] == found


def test_weights(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 64)
    docs = spark.range(1000).selectExpr("id doc_id", "repeat('word ', cast(1 + id % 500 as int)) text", "if(id % 10 = 0, 'few', 'many') source")
    mix = C.mixture(spark, docs, SF)
    mix.write.parquet(f"{tmp_path}/mix")
    rows = C.packing(spark, spark.read.parquet(f"{tmp_path}/mix"), SF).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    # counts to the power 0.5: one of four documents is of the small source until it runs out
    for k, own in enumerate(by_stretch(rows)[:5]):
        assert abs(sum(i % 10 == 0 for i in own) - 16) <= 16, k
    first = set().union(*by_stretch(rows)[:5])
    assert abs(sum(i % 10 == 0 for i in first) - 80) <= 8
    # the order within a stretch, and of rows that are no file's
    again = C.packing(spark, mix.checkpoint(), SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert P.packed_in_order(docs.where("false"), PATH).count() == 0


def test_stages_after_near_copies(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        before, columns = docs, docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        if k in (2, 3):
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
    check(docs.collect(), [(r.doc_id, r.text) for r in before.collect()])
