"""op4 against brute force."""

import numpy as np

from pairloom.llm import neighbours as N
from pairloom.llm.queries import op4_nearest_vectors


def slow(rows, k=10, every=100):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in rows:
        if i % every == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in rows if j != i)
            out[i] = found[:k]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r.rank
    return out


def test_table(spark):
    sf = "/root/testdata/sf0.1"
    want = slow([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    got = grouped(op4_nearest_vectors(spark, sf).collect())
    assert got.keys() == want.keys()
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found) and q not in [j for _, j in found]


def recall(got, want):
    return np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / max(1, len(want[q])) for q in want])


def visits(df, k=10, **how):
    """Leaves of the index, how many a query visits, and the part of the vectors that it meets there."""
    filed, found = N.indexed(df.selectExpr("vec_id id", "embedding v"), k, **how)
    counts = np.zeros(found.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    x = np.array([r.embedding for r in df.where("vec_id % 100 = 0").collect()], np.float64)
    routes = found.routes(x, counts, k + 1)
    return found.leaves, np.mean([len(r) for r in routes]), np.mean([counts[r].sum() for r in routes]) / counts.sum()


def test_visits(spark):
    """Fewer leaves are visited than there are, on the table and at both levels of parting; recall holds."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding is not null")
    leaves, visited, met = visits(table)
    print(leaves, visited, met)
    assert leaves >= 8 and visited < leaves
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(0, 0.25, 12)]) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for how in ({}, {"sample": 900, "split": 500}):
        leaves, visited, met = visits(df, **how)
        print(how, leaves, visited, met)
        assert met < 0.6 and visited < leaves
        assert recall(grouped(N.nearest(df, **how).collect()), slow(rows)) >= 0.9
    assert leaves > 40


def test_repeated_ids(spark):
    v, w = [1.0, 0.0], [0.0, 3.0]
    rows = [(100, v)] * 12 + [(i, v) for i in range(101, 116)] + [(500, w)] * 3 + [(7, [1.0, 0.5])] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = grouped(N.nearest(df).collect())
    assert got[100] == [(0.0, j) for j in range(101, 111)]
    want = slow(rows)
    assert {q: [j for _, j in f] for q, f in got.items()} == {q: [j for _, j in f] for q, f in want.items()}


def test_learned(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.3, 16)]) for i in range(2400)]
    rows += [(3000 + i, rows[0][1]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = slow(rows), grouped(N.nearest(df, block=100).collect())
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    assert all([j for _, j in got[q]] == [j for _, j in want[q]] for q in want if q >= 3000)


def test_corners(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, v), (8, [1.0, -0.0]), (8, v), (9, [1.0, 2.0, 3.0]), (100, v), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, id int")
    got = grouped(N.nearest(df).collect())
    assert got == {0: [(0.0, 8), (0.0, 8), (0.0, 100), (1.0, 1)], 100: [(0.0, 0), (0.0, 8), (0.0, 8), (1.0, 1)]}
    assert N.nearest(df.where("false")).count() == 0
