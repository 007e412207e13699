"""op6: held-out accuracy, and the parts against plain versions."""

import zlib

import numpy as np

from pairloom.llm import quality as Q
from pairloom.llm.queries import op6_quality_scores

SF = "/root/testdata/sf0.01"


def test_isotonic():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 40)
    y = np.array([rng.binomial(k, min(1, i / 40)) for i, k in enumerate(n)])
    at, value = Q.isotonic(n, y, np.arange(40.0))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all() and 0 <= value[0] and value[-1] <= 1
    # the greatest convex minorant of the cumulative sums
    total, ones = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(y)])
    slopes = [max(min((ones[j] - ones[i]) / (total[j] - total[i]) for j in range(k + 1, 41)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(np.unique(np.round(slopes, 9)), np.round(value, 9))


def test_held_out(spark):
    rows = op6_quality_scores(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_weights(spark):
    """Summed by partitions, against a plain ridge on the same features; and the calibration against plain bins."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(Q.features(docs), labels)
    x = {r.doc_id: Q.statistics(r.text or "") for r in docs.collect()}
    whole = np.array(list(x.values()))
    scale = whole.std(axis=0)
    assert np.allclose(model.mean, whole.mean(axis=0)) and np.allclose(model.scale, np.where(scale < 1e-9, 1, scale), rtol=1e-4, atol=1e-6)
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    late = {i for i in known if zlib.crc32(str(i).encode()) % 20 >= 16}
    early = [i for i in known if i not in late]
    z, y = model.lifted(np.array([x[i] for i in early])), np.array([known[i] for i in early], float)
    penalty = Q.RIDGE * len(early) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    some = model.lifted(whole[:200])
    assert np.allclose(some @ weights, some @ model.weights, atol=1e-6)
    raw = model.raw(np.array([x[i] for i in late]))
    bins = np.clip((raw + 1) / 3 * Q.BINS, 0, Q.BINS - 1).astype(int)
    truth = np.array([known[i] for i in late], float)
    n, ones, sums = (np.array([f(bins == b) for b in np.unique(bins)]) for f in (lambda m: m.sum(), lambda m: truth[m].sum(), lambda m: raw[m].mean()))
    at, chance = Q.isotonic(n, ones, sums)
    assert np.allclose(at, model.at) and np.allclose(chance, model.chance)


def test_corners(spark):
    docs = spark.createDataFrame([(1, "", 0), (2, None, 0), (None, "a b", 0), (4, "x" * 100000, 0), (4, "x" * 100000, 0)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(docs, labels).collect()} == {0.5}
    assert Q.quality_scores(docs.where("false"), labels).count() == 0
    labels = spark.createDataFrame([(4, 1), (1, 0), (1, None), (2, 1), (None, 1)], "doc_id long, quality int")
    assert Q.quality_scores(docs, labels).count() == 5
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 5
