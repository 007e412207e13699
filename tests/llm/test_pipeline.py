"""The stages against plain versions, each on its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from pairloom.llm import mixing as M
from tests.llm.test_near_copies import slow_kept
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def slow_cleaned(rows, length=100):
    """{id: text without the strings of so many bytes that also start earlier}; of a character removed in part all stays."""
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first.setdefault(data[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = b"\1" * length
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def in_file_order(df):
    rows = df.select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("k")).collect()
    return [r.doc_id for r in sorted(rows, key=lambda r: (r.f, r.k))]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        assert k == 4 or docs.columns == columns
    quality, near, suffix, mix, packed = (d.collect() for d in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in quality}
    assert np.mean([(i in left) == bool(q) for i, q in labels.items()]) > 0.9
    want, _ = slow_kept([(r.doc_id, r.text) for r in quality])
    assert sorted(r.doc_id for r in near) == want
    want = slow_cleaned([(r.doc_id, r.text) for r in near])
    assert {r.doc_id: r.text for r in suffix} == want and any(want[r.doc_id] != r.text for r in near)
    assert all(r.n_chars == len(r.text) for r in suffix)
    assert sorted(mix) == sorted(suffix)
    assert in_file_order(seen[3]) == [r.doc_id for r in M.mixed(seen[2]).sort("slot", "place").collect()]
    check(packed, [(r.doc_id, r.text) for r in mix])


def test_corners(spark, tmp_path):
    """Null ids and texts, empty ones, repeated rows and columns that clash, through all stages; and an empty table."""
    text = "It was a fine day; they went out, and they saw the sea. Then it rained. " * 6
    rows = [(None, text, "en", "a", 1), (None, None, None, None, 2), (3, "", "en", "a", 3), (4, text + "And so on, until the end of it.", "en", "b", 4), (4, text + "And so on, until the end of it.", "en", "b", 4), (5, "x " * 9000, "de", None, 5), (6, text, "en", "b", 6)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = own.withColumn("slot", F.lit(7)).withColumn("block", F.lit("k")).withColumn("component", F.lit(1.5)).withColumn("x", F.lit(True)).withColumn("kept", F.lit("y"))
    for name, docs in (("all", own), ("none", own.where("false"))):
        for k, (_, stage) in enumerate(C.STAGES[1:]):  # the classifier may reject any of them
            before, columns = docs, docs.columns
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 3 or docs.columns == columns
            if name == "none":
                assert docs.count() == 0
            elif k == 0:
                want, _ = slow_kept([(r[0], r[1]) for r in rows if r[0] is not None])
                assert sorted(str(r.doc_id) for r in docs.collect()) == sorted([*map(str, want), "None", "None"])
            elif k < 3:
                assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(str(r.doc_id) for r in before.collect())
            else:
                check(docs.collect(), [(r.doc_id, r.text) for r in before.collect()])
        kept = C.quality(spark, own if name == "all" else own.where("false"), SF)
        assert kept.columns == own.columns and kept.count() <= len(rows)


def test_run(spark):
    assert C.run(spark, SF).count() > 0
