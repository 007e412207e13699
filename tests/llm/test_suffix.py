"""op1 against brute force, and suffix arrays against sorting."""

import hashlib

import numpy as np
import pytest

from pairloom.llm import suffix as S


def slow(rows, length=100):
    rows = sorted(((-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows))
    seen = {}
    for i, t in rows:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            seen[k] = min(seen.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] < (i, s):
                gone[s : s + length] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def got(df, **how):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(df, **how).collect())


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(c) for c in rng.integers(97, 107, rng.integers(1, 7))) for _ in range(60)] + ["é", "\0", "ß日"]
    passages = [" ".join(rng.choice(words, rng.integers(10, 80))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.integers(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words, rng.integers(1, 50)))
            if rng.random() < 0.3:
                text = text[rng.integers(0, 40) :]
        rows.append((int(rng.integers(0, 10 * n)), text))
    rows = list(dict(rows).items())
    return rows + [(10 * n + 1, "ab" * 3000), (10 * n + 2, "x" * 1000), (10 * n + 3, "x" * 99), (10 * n + 4, None), (10 * n + 5, ""), (10 * n + 6, "ab" * 90), (None, "x" * 120)]


def test_made(spark):
    rows = made(4, 120)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, a int")
    assert got(df) == slow(rows)


def test_rows_of_one_id(spark):
    """Rows without an id, or of one id, are dealt by their content; where they start alike neither is earlier."""
    rng = np.random.default_rng(8)
    passage = "".join(chr(c) for c in rng.integers(97, 123, 400))
    rows = [(None if k % 3 else 7, (passage if k % 2 else passage[: 150 + k]) + f" {k} " * 5) for k in range(24)]
    rows += [(None if k % 2 else 7, f"{k}" * (k % 5) + passage[k:]) for k in range(12)] + [(9, passage + "!"), (3, passage[:120]), (8, "?" + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == slow(rows)


def test_crowds_on_spark(spark):
    rows = made(6, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, crowd=1) == got(df) == slow(rows)


def test_crowd():
    import pyarrow as pa

    rows = made(5, 80)
    texts = sorted((-5 if i is None else i, (t or "").encode()) for i, t in rows)
    ids = np.array([i for i, _ in texts])
    for crowd in (2000, 1):
        left = pa.RecordBatch.from_arrays([pa.array([3] * len(ids), pa.int32()), pa.array(ids), pa.array(ids), pa.array([t for _, t in texts])], names=["part", "doc", "key", "text"])
        folded = pa.Table.from_batches(list(S._folded(100)(iter([left])))).sort_by([(n, "ascending") for n in ("a", "c", "doc", "at")])
        said = pa.Table.from_batches(list(S._judged(iter(folded.combine_chunks().to_batches()), crowd)))
        assert crowd > 1 or S.CROWDED in said["kind"].to_pylist()
        wanted = S._wanted(100)(pa.Table.from_batches([left]), said).sort_by([(n, "ascending") for n in ("a", "doc", "start")])
        spans = list(S._compared(100)(iter(wanted.combine_chunks().to_batches())))
        out = S._cleaned(100, False, [])(pa.Table.from_batches([left]), pa.concat_tables([said, pa.Table.from_batches(spans)]))
        assert sorted(zip(*(out[n].to_pylist() for n in out.column_names), strict=True)) == sorted((-5 if r[0] == -(1 << 63) else r[0], *r[1:]) for r in slow(rows))


@pytest.mark.parametrize("shard", [6 << 20, 2000])
def test_repeats(shard):
    rows = [(-1 if i is None else i, (t or "").encode().replace(b"\0", b"\xff")) for i, t in made(7, 60)]
    rows.sort()
    found = S.repeats([t for _, t in rows], np.array([i for i, _ in rows]), np.zeros(len(rows), np.int64), 100, shard)
    for (_, t), f in zip(rows, found, strict=True):
        assert len(f) == max(0, len(t) - 99)
    seen = {}
    for i, t in rows:
        for s in range(len(t) - 99):
            seen[t[s : s + 100]] = min(seen.get(t[s : s + 100], (i, s)), (i, s))
    for (i, t), f in zip(rows, found, strict=True):
        assert f.tolist() == [seen[t[s : s + 100]] < (i, s) for s in range(len(t) - 99)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    data = rng.integers(1, 4, 700).astype(np.uint8)
    data[300:500] = data[:200]
    order, rank = S.suffix_array(data)
    text = data.tobytes()
    assert order.tolist() == sorted(range(700), key=lambda k: text[k:]) and (order[rank] == np.arange(700)).all()
    got_ = S.common_prefixes(data, order, rank, np.array([0, 100, 450]), 100)
    for r in range(1, 700):
        a, b = text[order[r - 1] :], text[order[r] :]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert got_[order[r]] == min(n, 100)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_same_id(spark):
    df = spark.createDataFrame([(1, "y" + "abc " * 60), (1, "y" + "abc " * 60), (2, "zzz " + "abc " * 60), (1, "q" * 20)], "doc_id long, text string")
    rows = got(df)
    assert len(rows) == 4 and rows[1:3] == [rows[1]] * 2
    assert S.without_repeats(df.where("false")).count() == 0


def test_cleaned(spark):
    shared = "".join(chr(224 + k * k % 31) for k in range(60)) + " shared words stand here for all to see, again and again"
    rows = [(1, "A " + shared, "x", 5, 1), (2, "B " + shared + " end", None, 6, 2), (3, None, "z", 0, 3), (4, shared, "x", 1, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long, n_spans int")
    out = {r.doc_id: r for r in S.cleaned(df).collect()}
    assert out[1].text == "A " + shared and out[2].text == "B end" and out[3].text == "" and out[4].text == ""
    assert all(r.n_chars == len(r.text) for r in out.values()) and S.cleaned(df).columns == df.columns
    assert [(out[k].kept, out[k].n_spans) for k in (1, 2, 3, 4)] == [(r[2], r[4]) for r in rows]
