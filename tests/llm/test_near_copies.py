"""The pipeline's near copies against all pairs of the table."""

from collections import defaultdict

import corpus_pipeline as C
import pytest

from pairloom.llm import simhash as S


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def slow_kept(rows):
    """Ids that are the smallest of what Jaccard similarities of 0.8 connect; and how many pairs of different sets have it."""
    sets, holds = [shingles(t) for _, t in rows], defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or [()]:
            holds[x].append(k)
    label, pairs = list(range(len(rows))), 0

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s or [()]:
            for j in holds[x]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if not s or n >= 0.8 * (len(s) + len(sets[j]) - n):
                pairs += s != sets[j]
                a, b = root(j), root(k)
                label[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(least.values()), pairs


def test_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want, pairs = slow_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert pairs > 20
    got = sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").select("doc_id").collect())
    print(len(want), len(got), pairs)
    assert got == want


@pytest.mark.parametrize("tile", [1024, 4])
def test_tiles(spark, tile):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:58], f"v{k}", "z"])) for k in range(30)]
    rows += [(100 + k, " ".join(f"u{k}_{j}" for j in range(5 + k))) for k in range(10)] + [(200, ""), (201, None), (202, " "), (203, "w0 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = slow_kept(rows)
    assert sorted(r.doc_id for r in S.one_of_near_copies(df, tile=tile).collect()) == want
    assert S.one_of_near_copies(df.where("false")).count() == 0
