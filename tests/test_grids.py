"""Pairs judged as matrices: against all pairs one by one, and against the measures that judge a pair a row."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.config import Matching
from pairloom.functions import similarity as S
from pairloom.functions.text import clean, clean_map
from pairloom.operators import blocking as B
from pairloom.operators import grids as G
from pairloom.operators import matching as P
from pairloom.operators import measures as N
from pairloom.sources import products as X

SF = "/root/testdata/sf0.001"


def products(n=90):
    rng = random.Random(5)
    size = lambda: rng.choice([1.0, 1.5, 1.99, 2.0, 2.4, 3.0, 3.2, 7.9, 8.1])
    return [(k, rng.choice(["a.com", "b.com", "shop.a.com", None]), rng.choice(["x", "y", None]), [size() for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for k in range(n)]


@pytest.mark.parametrize("part", [8192, 20])
def test_each_pair_once(spark, monkeypatch, part):
    monkeypatch.setattr(G, "PART", part)  # many units a block
    rows = products()
    own = spark.createDataFrame(rows, "product_id long, shop string, brand string, sizes array<double>")

    def shop(a, b):
        return a is not None and b is not None and (a in b or b in a)

    for rule in (G.Rule(shop=True), G.Rule(brand="other"), G.Rule(shop=False, brand="like"), G.Rule(brand="same", size="other"), G.Rule(shop=False, brand="like", size="like")):
        want = {"size": set(), "brand": set()}
        for (i, sa, ba, za), (j, sb, bb, zb) in itertools.combinations(rows, 2):
            like = any(abs(x - y) < 1 for x in za for y in zb)
            other = None not in (ba, bb) and ba != bb
            ok = rule.shop in (None, shop(sa, sb)) and {None: True, "other": other, "like": not other, "same": ba is not None and ba == bb}[rule.brand] and rule.size in (None, "like" if like else "other")
            if ok and like:
                want["size"].add((i, j))
            if ok and not other:
                want["brand"].add((i, j))
        got = [tuple(r) for r in G.by_size(own, rule).collect()]
        assert len(got) == len(set(got)) and set(got) == want["size"], rule
        if rule.brand in ("same", "like"):
            got = [tuple(r) for r in G.by_brand(own, rule).collect()]
            assert len(got) == len(set(got)) and set(got) == want["brand"], rule
    assert G.by_size(own.where("false"), G.Rule()).count() == 0 and G.by_brand(own.where("false"), G.Rule()).count() == 0


@pytest.mark.parametrize("alike", [256, 3])
def test_rows_of_alike_products(spark, monkeypatch, alike):
    """Products that are alike come as one row, in pieces, and give the pairs that they give one by one."""
    monkeypatch.setattr(G, "PART", 40)
    monkeypatch.setattr(G, "ALIKE", alike)
    raw = X.raw_parts(spark, SF).where("product_id <= 60")
    raw = raw.unionByName(raw.withColumn("product_id", F.col("product_id") + 1000))
    raw = raw.unionByName(raw.where("product_id < 9").crossJoin(spark.range(1, 8)).withColumn("product_id", F.col("product_id") + F.shiftleft("id", 20)).drop("id"))
    known = P.brands(raw)
    one, rows = P.prepared(X.cleaned(raw), known).persist(), P.prepared(X.cleaned(X.alike(raw)), known).persist()
    assert rows.count() < one.count() == rows.agg(F.sum(F.size("ids"))).first()[0]
    for fast in (False, True):
        method = P.msmp_fast if fast else P.msmp
        want, got = (sorted(tuple(r) for r in method(own, digits=6).collect()) for own in (one, rows))
        assert want == got and want
    want, got = ({tuple(r) for r in G.by_brand(own, G.Rule(brand="same", size="other")).collect()} for own in (one, rows))
    assert want == got and want


def test_gated_without_listing_candidates(spark, monkeypatch):
    """Pairs that share a band, found where they meet, are the candidates' pairs; in several parts a block."""
    monkeypatch.setattr(G, "GATED", 30)
    raw = X.raw_parts(spark, SF).where("product_id <= 110")
    raw = raw.unionByName(raw.where("product_id <= 30").withColumn("product_id", F.col("product_id") + 1000))
    products, rows = X.cleaned(raw), X.cleaned(X.alike(raw))
    words = B.vocabulary(products).persist()
    hashes = B.Hashes.of(words.count())
    known = P.brands(raw)
    own = P.prepared(rows, known).join(B.packed(B.incidence(rows, words), hashes), "product_id").persist()
    met = B.candidates(B.signatures(B.incidence(products, words), hashes), 0.3, hashes.n).persist()
    for fast, method in ((False, P.msmp), (True, P.msmp_fast)):
        want = sorted(tuple(r) for r in method(P.prepared(products, known), met, digits=6).collect())
        got = P.msmp_gated(own, 0.3, hashes.n, fast=fast, digits=6)
        assert sorted(tuple(r) for r in got.collect()) == want and want


def test_measures(spark):
    m = Matching(gamma=0.3)
    own = P.prepared(X.parts(spark, SF), P.brands(X.raw_parts(spark, SF))).persist()
    a, b = F.col("a"), F.col("b")
    pairs = P.allowed(P.like_size(own), fast=True)
    match = P.attribute_match(a["features"], b["features"], m)
    kinds = {
        "jaccard": [S.jaccard(a["value_words"], b["value_words"])], "cosine": [S.cosine(a["title"]["words"], b["title"]["words"])],
        "veto": [S.clashes(a["title"]["hybrids"], b["title"]["hybrids"]), S.clashes(a["title"]["hybrids"], b["title"]["hybrids"]) >= 2],
        "edit": [S.mean_edit_similarity(a["title"]["model_words"], b["title"]["model_words"])], "hybrid": [S.mean_hybrid_similarity(a["title"]["hybrids"], b["title"]["hybrids"])],
        "title": [F.coalesce(S.title_similarity(a["title"], b["title"], m), F.lit(-1.0))],
        "attributes": [match["m"], match["w"], F.coalesce(F.try_divide(match["sim"], match["w"]), F.lit(0.0))],
    }
    rule = G.Rule(shop=False, brand="like")
    for kind, columns in kinds.items():
        want = {(r[0], r[1]): r[2:] for r in pairs.select("a.product_id", "b.product_id", *columns).collect()}
        got = {(r[0], r[1]): r[2:] for r in G.by_size(own, rule, N.Measure(kind, m, None)).collect()}
        assert want.keys() == got.keys() and want
        assert all(math.isclose(x, y, abs_tol=1e-12) for k in want for x, y in zip(want[k], got[k], strict=True)), kind
    for fast, found in ((True, P.msmp_fast(own)), (False, P.msmp(own))):
        want = {(r.id_a, r.id_b): r.dist for r in P.distances(P.allowed(P.like_size(own) if fast else P.like_brand(own), fast=fast), fast=fast).collect()}
        got = {(r.id_a, r.id_b): r.dist for r in found.collect()}
        assert want.keys() == got.keys() and all(math.isclose(want[k], got[k], abs_tol=1e-12) for k in want)


def test_sums_of_many_items(monkeypatch):
    """Beyond MOST items only those at hand are compared, with the same sums."""
    rng = random.Random(6)
    rows = [rng.sample(["ab", "b1", "abc", "c", "cab1"], rng.randint(0, 4)) for _ in range(30)]
    a, b = np.arange(0, 30, 2), np.arange(1, 30, 3)
    made = lambda x, y: [N.edits(x, y)]
    whole = N.Items(rows).sums("e", made, a, b)[0]
    monkeypatch.setattr(N, "MOST", 0)
    own = N.Items(rows)
    assert np.allclose(own.sums("e", made, a, b)[0], whole) and not own.tables
    assert np.allclose(whole, [[sum(N.edits([x], [y])[0, 0] for x in rows[i] for y in rows[j]) for j in b] for i in a])
    assert (own.shared(a, b) == [[len(set(rows[i]) & set(rows[j])) for j in b] for i in a]).all()


def test_edits(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abé1") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    rows = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(words) for j, y in enumerate(words)], "i int, j int, x string, y string")
    got = N.edits(words, words)
    assert all(math.isclose(r.s, got[r.i, r.j], abs_tol=1e-12) for r in rows.select("i", "j", S.edit_similarity(F.col("x"), F.col("y")).alias("s")).collect())


def test_clean_alike_with_and_without_units(spark):
    rows = spark.createDataFrame([(t,) for t in ("5 lbs", "5  lbs", "5 - -inch", "3-Hz", '7"', "7 'x", "Note 7", "x", "", None, "1/8 inch 5 Pounds 2 pounds", "٣ Inch")], "t string")
    got = [r.x for r in rows.select(clean(F.col("t")).alias("x")).collect()]
    assert got == ["5lbs", "5lbs", "5inch", "3hz", "7inch", "7 'x", "note 7", "x", "", None, "1/8inch 5 pounds 2lbs", "٣inch"]
    maps = spark.sql("select map('A', '1 Hz', 'b', '2') f union all select map('A', '1', 'a', '2') union all select map()").select(clean_map(F.col("f")).alias("f")).collect()
    assert sorted(len(r.f) for r in maps) == [0, 1, 2] and any(r.f == {"a": "2"} for r in maps)


def test_table_is_spread_before_it_is_cleaned(spark):
    """One file's rows are dealt out to all cores before, not after, what is made of them."""
    plan = X.parts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobinPartitioning" in plan and plan.index("map_entries") < plan.index("Exchange RoundRobinPartitioning")


@pytest.mark.parametrize("high,wide", [(1, 1), (2, 3)])
def test_lists_of_pairs(spark, monkeypatch, high, wide):
    """Pairs leave as lists; cut into short ones they are the same rows, and no list is longer."""
    rows = [(k, f"{'abc'[k % 3]}.com", None, [1.0], [f"w{k % 5}", "x", f"y{k % 2}"]) for k in range(40)]
    own = spark.createDataFrame(rows, "product_id long, shop string, brand string, sizes array<double>, words array<string>").withColumn("title", F.struct("words"))
    rule, measure = G.Rule(shop=False, brand="like"), N.Measure("cosine")

    def found(bands=None):
        gated = own.withColumn("signature", F.lit(b"abcd")) if bands else own
        by = G.by_size(gated, G.Rule(shop=False, brand="like", bands=bands, numbers=2), measure)
        return sorted(map(tuple, by.collect()))

    want = found()
    assert len(want) == len({r[:2] for r in want}) == sum(a[1] != b[1] for a, b in itertools.combinations(rows, 2))
    for a, b, cosine in want:
        assert cosine == pytest.approx(len(set(rows[a][4]) & set(rows[b][4])) / 3, abs=1e-6)
    monkeypatch.setattr(G, "HIGH", high)
    monkeypatch.setattr(G, "WIDE", wide)
    assert found() == want
    assert found((2, 1)) == want  # all share a band
    n, m = G._cut(np.array([7, 0, 3]), 3)
    assert n.tolist() == [0, 0, 0, 2] and m.tolist() == [3, 3, 1, 3]


def test_alike_parts(spark, tmp_path):
    """Grouped before products are made, they are the rows of alike, of copies with other keys and of missing values too."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    copies = [part.withColumn("p_partkey", F.col("p_partkey") + k * 6930) for k in range(5)]
    gone = part.limit(20).withColumn("p_partkey", F.col("p_partkey") + 10**7).withColumn("p_brand", F.lit(None).cast("string"))
    for df in [*copies[1:], gone]:
        copies[0] = copies[0].unionByName(df)
    copies[0].write.parquet(f"{tmp_path}/part.parquet")
    have, want = X.alike_parts(spark, str(tmp_path)), X.alike(X.raw_parts(spark, str(tmp_path)))

    def rows(df):
        return sorted((r.product_id, sorted(r.ids), r.shop, r.title, sorted(r.features.items(), key=str)) for r in df.collect() if r.ids)

    have, want = rows(have), rows(want)
    one = {i: (r[2:]) for r in want for i in r[1]}
    assert sorted(i for r in have for i in r[1]) == sorted(one) and all(one[i] == r[2:] for r in have for i in r[1])
    assert len(have) < len(one) / 1.5


@pytest.mark.parametrize("most", [3000, 0])
def test_measures_of_pairs(monkeypatch, most):
    """Pairs measured one by one are those of the matrix, to the last bit; also where words are too many for a table of all."""
    monkeypatch.setattr(N, "MOST", most)
    rng = np.random.default_rng(5)
    texts = ["led40", "hd1080p", "40inch", "120hz", "b7x", "7bx", "ab12cd"]
    draw = lambda: [texts[k] for k in sorted(set(rng.integers(0, 7, 4).tolist()))][: int(rng.integers(0, 5))]
    rows = [draw() for _ in range(300)]
    hybrid = lambda w: {"word": w, "number": "".join(filter(str.isdigit, w)), "letters": "".join(filter(str.isalpha, w))}
    kind = pa.list_(pa.struct([("word", pa.string()), ("number", pa.string()), ("letters", pa.string())]))
    table = pa.table({
        "words": rows, "model_words": [draw() for _ in rows], "hybrids": pa.array([list(map(hybrid, r)) for r in rows], kind), "value_words": [draw() for _ in rows],
        "n_features": rng.integers(18, 24, 300).tolist(),
    })
    for name in ("msmp", "fast"):
        measured = N.Measure(name, digits=None).of(table, np.arange(300))
        a, b = rng.integers(0, 300, (2, 1000))
        got = measured.paired(a, b)[0]
        want = np.array([measured.values(a[k : k + 1], b[k : k + 1])[0][0, 0] for k in range(1000)])
        assert (got == want).all() and len(set(want)) > 20
