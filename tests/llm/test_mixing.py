"""op3: every prefix of the mix against its targets, counted plainly."""

import re

import numpy as np
import pytest

from pairloom.llm import mixing as M
from pairloom.llm.queries import op3_mixed_sources


def check_order(order, blocks, shares):
    """order: sources of the slots. Within a phase (until one runs out) each is within one block of its share."""
    left, at = dict(enumerate(blocks)), 0
    while at < len(order):
        active = [k for k, n in left.items() if n]
        total = sum(shares[k] for k in active)
        had = dict.fromkeys(active, 0)
        t = 0
        while at < len(order):
            k = order[at]
            had[k] += 1
            left[k] -= 1
            at += 1
            t += 1
            assert all(abs(had[j] - t * shares[j] / total) < 1 for j in active)
            if not left[k]:
                break
    assert not any(left.values())


def test_phases():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        blocks = rng.integers(1, 120, n).tolist()
        shares = M.whole_shares(rng.random(n).tolist(), int(rng.integers(1, 60)))
        slots = {}
        for k, own in enumerate(M.phases(blocks, shares)):
            for b in range(blocks[k]):
                p = [p for p in own if p["first"] <= b][-1]
                j = b - p["first"]
                slots[p["base"] + j // len(p["slots"]) * p["period"] + p["slots"][j % len(p["slots"])]] = k
        assert sorted(slots) == list(range(sum(blocks)))
        check_order([slots[s] for s in sorted(slots)], blocks, shares)


def check(rows, total, block):
    assert len(rows) == total
    by = {}
    for r in rows:
        by.setdefault(r.slot, []).append(r)
    assert sorted(by) == list(range(len(by)))
    last = {}
    for s, held in by.items():
        assert len({(r.source, r.block) for r in held}) == 1 and sorted(r.place for r in held) == list(range(len(held)))
        last[held[0].source] = max(last.get(held[0].source, 0), held[0].block)
    assert all(len(h) == block or h[0].block == last[h[0].source] for h in by.values())
    return [by[s][0].source or "" for s in sorted(by)]


def test_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = op3_mixed_sources(spark, sf).collect()
    counts = {r.source: r.n for r in spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").count().withColumnRenamed("count", "n").collect()}
    order = check(rows, sum(counts.values()), M.BLOCK)
    names = sorted(counts)
    shares = M.whole_shares([counts[s] ** 0.5 for s in names], M.PERIOD)
    check_order([names.index(s) for s in order], [-(-counts[s] // M.BLOCK) for s in names], shares)


def test_corners(spark, monkeypatch):
    monkeypatch.setattr(M, "RANKED", 10)
    rows = [(None if i % 5 == 0 else i // 2, None if i < 30 else "a" if i < 200 else "b", "t", 7) for i in range(230)] + [(1, "a", "t", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    out = M.mixed(df, {"": 1, "a": 2, "b": 5}, block=4, period=8).collect()
    order = check(out, len(rows), 4)
    names = ["", "a", "b"]
    check_order([names.index(s) for s in order], [8, 44, 8], [1, 2, 5])
    assert M.mixed(df.where("false")).count() == 0
    whole = M.in_mix_order(df, block=4)
    assert whole.columns == df.columns and sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))


def test_crowded_ids(spark, monkeypatch):
    """Rows without an id, or of one id, are parted by what they hold; ranks stay whole."""
    monkeypatch.setattr(M, "RANKED", 10)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "a" if i % 4 else "b", f"t{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = M.mixed(df, {"a": 3, "b": 1}, block=4, period=4)
    plan = out._jdf.queryExecution().toString()
    assert "__parts" in plan
    order = check(out.collect(), 1200, 4)
    check_order([["a", "b"].index(s) for s in order], [225, 75], [3, 1])


def test_many_sources(spark):
    """More sources than are planned one by one: all rows come, large ones keep their shares, the rest theirs together."""
    rows = [(i, "big") for i in range(800)] + [(1000 + i, "mid") for i in range(400)] + [(2000 + i, f"s{i % 60}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"big": 40.0, "mid": 20.0} | {f"s{k}": 0.5 if k % 2 else 1.0 for k in range(60)}
    for given in (weights, None):
        order = check(M.mixed(df, given, block=4, planned=3).collect(), len(rows), 4)
        names = ["big", "mid"]
        grouped = [names.index(s) if s in names else 2 for s in order]
        own = given or {s: n**0.5 for s, n in {"big": 800, "mid": 400, **{f"s{k}": 15 for k in range(60)}}.items()}
        tail = sum(w for s, w in own.items() if s not in names)
        check_order(grouped, [200, 100, 240], M.whole_shares([own["big"], own["mid"], tail], M.PERIOD))
        rest = [s for s in order if s not in names]
        left = {s: 4 for s in own if s not in names}
        for n, s in enumerate(rest, 1):
            left[s] -= 1
            if given and 0 not in left.values():
                assert all(abs(4 - left[s] - n * own[s] / tail) <= 1 + 60 * own[s] / tail for s in left)
        assert M.mixed(df, given, block=4, planned=62).count() == len(rows)


def test_missing_weight(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    for given in ({"a": 1.0}, {"a": 1.0, "b": 0.0}, {}):
        with pytest.raises(ValueError):
            M.mixed(df, given)


def test_native(spark):
    df = spark.range(100).selectExpr("id doc_id", "cast(id % 3 as string) source")
    for planned in (512, 2):
        assert not re.search("Python|Pandas|Arrow", M.mixed(df, planned=planned)._jdf.queryExecution().toString())
