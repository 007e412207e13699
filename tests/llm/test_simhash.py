"""op2 against a brute-force version."""

import itertools

import numpy as np
import pytest
import xxhash

from pairloom.llm import simhash as S


def slow_fingerprint(text):
    words, word = [], b""
    for c in (text or "").encode():
        if c in b" \t\n\r\x0b\x0c":
            words, word = words + [word], b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    words = [w for w in [*words, word] if w]
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, distance=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(fps)), 2):
            if bin(fps[i] ^ fps[j]).count("1") <= distance and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return [min((ids[j] for j in range(len(fps)) if label[j] == label[i])) for i in range(len(fps))]


ROWS = [
    (7, "The quick brown fox jumps over the lazy dog and runs away from here"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away from here"),
    (9, "The quick brown fox jumps over the lazy dog and runs away from there"),
    (1, ""), (2, None), (4, " \t\n"), (5, "one"), (6, "one two"), (8, "ÄÖ one two three"), (10, "x " * 30000),
    (7, "The quick brown fox jumps over the lazy dog and runs away from here"),
]


def test_small(spark):
    df = spark.createDataFrame([(i, t, "c", 0, 1) for i, t in ROWS], "doc_id long, text string, fp string, component int, size int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(df).collect())
    fps = [slow_fingerprint(t) for _, t in ROWS]
    comp = slow_components(fps, [i for i, _ in ROWS])
    assert got == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(ROWS, fps, comp))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0


@pytest.mark.parametrize("group", [4096, 16])
def test_links_connect(spark, group):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(int(b) for b in base)
    for b in base[:6]:
        for _ in range(40 if b != base[0] else 200):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = S.links(df, 3, group).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in found)
    parent = {x: x for x in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[top(r.a)] = top(r.b)
    want = slow_components(fps, list(range(len(fps))))
    mine = [top(x) for x in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_one_of_each(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, extra int")
    ids = sorted(r.doc_id for r in S.one_of_each(df).collect())
    assert 7 not in ids and 3 in ids and len(ids) == len(set(ids)) and S.one_of_each(df).columns == df.columns


def correlated(n, seed=3):
    """Fingerprints of which bits 0 to 15 vary together in fours, and the counts of their pairs of bits."""
    rng = np.random.default_rng(seed)
    bits = rng.random((n, 64)) < rng.uniform(0.3, 0.7, 64)
    for k in range(16):
        bits[:, k] = np.where(rng.random(n) < 0.9, bits[:, k - k % 4], bits[:, k])
    x = bits.astype(float)
    return bits, x.T @ x


def test_chances():
    """Mean and variance of differing bits against counted pairs, of bits that vary together and of others."""
    bits, both = correlated(4000)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4000, 200_000), rng.integers(0, 4000, 200_000)
    for own in (list(range(12)), list(range(30, 42))):
        differ = (bits[a][:, own] != bits[b][:, own]).sum(axis=1)
        chance, d = S._apart(4000, both, own, 12), np.arange(13)
        mean = (chance * d).sum()
        assert np.isclose(chance.sum(), 1) and np.isclose(mean, differ.mean(), rtol=0.03)
        assert np.isclose((chance * d * d).sum() - mean**2, differ.var(), rtol=0.05)
    assert np.allclose(chance, np.bincount(differ, minlength=13) / len(a), atol=0.01)
    assert S._apart(4000, both, list(range(12)), 0)[0] > 3 * S._apart(4000, both, list(range(30, 42)), 0)[0]


@pytest.mark.parametrize("distance", [3, 12])
@pytest.mark.parametrize("filing", [1e-9, 20, 1e12])
def test_plan_covers(distance, filing):
    """Any two fingerprints within the distance have a value in common, whatever entries cost."""
    _, both = correlated(500)
    parts = S.plan(500, both, distance, filing=filing)
    assert sum(2 * r + 1 for _, r in parts) > distance and len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)
    rng = np.random.default_rng(2)
    for _ in range(500):
        flipped = set(rng.choice(64, rng.integers(0, distance + 1), replace=False).tolist())
        bits, r = min(parts, key=lambda p: len(flipped & set(p[0])) - 2 * p[1])
        d = len(flipped & set(bits))
        assert d <= 2 * r and S._meetings(len(bits), r, d) > 0
    assert S._meetings(5, 1, 0) == 6 and S._meetings(5, 1, 1) == 2 == S._meetings(5, 1, 2) and S._meetings(5, 1, 3) == 0
