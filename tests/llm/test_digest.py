"""op10 against a plain version of its contract, and its likeness on edits."""

import hashlib
import math
from collections import Counter

import numpy as np

from pairloom.llm import digest as D
from pairloom.llm.queries import op10_digest_likeness

SF = "/root/testdata/sf0.01"


def slow_class(window):
    total = sum(int(np.rint(c * math.log2(c) * 16)) for c in Counter(window).values())
    return 1024 - total * 1024 // (16 * 16 * 4)


def slow_features(text, rank):
    data = text.encode()
    if len(data) < 16:
        return [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")] if data else []
    keys = [(rank[slow_class(data[i : i + 16])], i) for i in range(len(data) - 15)]
    noted = Counter()
    for at in range(-31, len(keys)):
        noted[min(keys[max(0, at) : at + 32])[1]] += 1
    out = []
    for i in sorted(k for k, n in noted.items() if n >= 8):
        h = 0
        for k in range(2):
            h = (h ^ int.from_bytes(data[i + 8 * k : i + 8 * k + 8], "little")) * int(D._MIX[k]) % 2**64
            h ^= h >> 29
        out.append((h * int(D._MIX[1]) % 2**64) ^ (h >> 32))
    return out


def slow_filters(features):
    out = []
    for k in range(0, len(features), 128):
        out.append((len(features[k : k + 128]), {(f >> 11 * j) & 2047 for f in features[k : k + 128] for j in range(5)}))
    return out


def slow_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    if a == b:
        return 1.0
    score = lambda x, y: min(1.0, max(0.0, (len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9)))
    total = sum(n * max(score(x, y) for _, y in b) for n, x in a) + sum(n * max(score(x, y) for _, y in a) for n, x in b)
    return total / (sum(n for n, _ in a) + sum(n for n, _ in b))


def test_entropy():
    x = np.random.default_rng(1).integers(97, 110, 3000).astype(np.uint8)
    got = D.entropy_classes(x)
    assert [int(g) for g in got[::13]] == [slow_class(x[i : i + 16].tolist()) for i in range(0, len(got), 13)]
    assert len(D.entropy_classes(x[:15])) == 0 and len(D.entropy_classes(x[:16])) == 1


def test_against_plain_version(spark):
    """Fingerprints and likeness of texts of all lengths, the ranks counted over them, against plain loops."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").collect() if r.text and len(r.text) < 4000]
    docs += [(1000 + n, "Wie dann ein äöü 12 went; to the end, of it. " * 9) for n in range(2)] + [(2000 + n, ("ab cd efg " * 5)[:n]) for n in (1, 8, 15, 16, 17, 31, 48)]
    docs += [(3000, "z" * 5000), (3001, "")]
    counts = [0] * 1025
    for _, t in docs:
        data = t.encode()
        for i in range(len(data) - 15):
            counts[slow_class(data[i : i + 16])] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert D.class_counts(df) == counts
    rank = D.ranked(counts).tolist()
    got = {r.doc_id: r for r in D.digests(df).collect()}
    made = {i: slow_filters(slow_features(t, rank)) for i, t in docs}
    docs.sort()
    for (i, t), (j, following) in zip(docs, docs[1:] + docs[:1]):
        features, filters = slow_features(t, rank), made[i]
        shown = f"{len(features):x}:" + "".join(np.packbits(np.isin(np.arange(2048), list(bits))).tobytes().hex() for _, bits in filters)
        assert got[i].fingerprint == shown
        edited = slow_filters(slow_features(D._edited(t, following), rank))
        assert math.isclose(got[i].near_next, slow_likeness(filters, made[j]), abs_tol=1e-9)
        assert math.isclose(got[i].near_edited, slow_likeness(filters, edited), abs_tol=1e-9)


def test_near_across_lengths():
    rank = D.ranked([0] * 1025)
    text = "It was then that they met; nobody else 1234 had seen the two of them (or so they said), by the water. " * 2
    a, b = D.digests_of([text[:191], text[:192]], rank)
    assert a.likeness(b) > 0.8


def check(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    assert len(got) == len(rows)
    by = {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        part = len(t) // 4
        edited = t[: len(t) - part] + following[:part]
        by.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    for r in got:
        by[r.doc_id].remove((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert not any(by.values())


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op10_digest_likeness(spark, SF).collect()
    check(docs, got)
    text = dict(docs)
    seen = {}
    for r in got:
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited >= 0.5 for r in got]) > 0.97
    assert np.mean([r.near_next for r in got]) < 0.1


def test_corners(spark):
    rows = [(5, ""), (1, None), (2, "a"), (9, "x" * 70000), (3, "ä" * 100), (3, "word " * 50), (None, "some text"), (8, "x" * 70000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, part int, id int")
    got = D.digests(df).collect()
    check(rows, got)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[1].fingerprint == "0:" and by[8].fingerprint == by[9].fingerprint and by[8].near_next == 1
    one = D.digests(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert D.digests(df.where("false")).count() == 0
