"""Golden values of cleaning, tokens and similarities; blocking, distances and clusters against plain versions."""

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pairloom.config import Matching
from pairloom.functions import similarity as S
from pairloom.functions import tokens as T
from pairloom.functions.text import clean, clean_map, plain_title, words
from pairloom.operators import blocking as B
from pairloom.operators import clustering as C
from pairloom.operators import matching as P
from pairloom.operators import metrics as E
from pairloom.operators import sampling as R
from pairloom.operators.components import connected_components
from pairloom.operators.numbering import numbered
from pairloom.plans import queries as Q
from pairloom.sources import products as X

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Samsung 55-Inch LED", "samsung 55inch led"), ('55" Class', "55inch class"), ("28-1/4 Inches", "28.2inch"), ('11-1/8"', "11.1inch"), ("60 Hz", "60hz"),
        ("120-Hertz", "120hz"), ("25 lbs", "25lbs"), ("25 pounds", "25lbs"), ("25 Pounds", "25 pounds"), ("40 INCH", "40 inch"), ("5-1/0inch", "5-1/0inch"), ("", ""),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, clean(F.col("t")), t=text) == want


def test_clean_map(spark):
    rows = spark.sql("select map('A', '1 Hz', 'b', '2', 'a', '3\"') f").select(clean_map(F.col("f")).alias("f")).first()
    assert rows.f == {"a": "3inch", "b": "2"}


def test_tokens(spark):
    title = "samsung un55es8000 55inch 1080p kdl-55w802a 120hz 3d v2 1,080"
    assert one(spark, T.counted_title_words(F.col("t")), t=title) == ["un55es", "55inch", "1080p", "kdl-55", "120hz", "3d", "v2"]
    assert one(spark, T.model_words(F.col("t")), t="Sony HDTV 55in tv 55 LED") == ["55in", "HDTV", "LED"]
    for value, want in {"1080p": ["1080"], "55": [""], "55.5inch": ["55.5"], "yes": [], "12a 34b": ["34"], "1.2.3in": ["2.3"], "60 hz": [], "1920 x 1080": [""]}.items():
        assert one(spark, T.counted_numbers(F.create_map(F.lit("k"), F.col("v"))), v=value) == want, value
    assert one(spark, T.screen_sizes(F.create_map(F.lit("screen size"), F.col("v"))), v="55.5Inch or 50inch, 3 ports") == [55.5, 50.0]
    assert one(spark, T.screen_sizes(F.create_map(F.lit("display size (in)"), F.col("v"))), v="55 / 12.5") == [55.0, 12.5]
    assert one(spark, T.hybrids(F.array("w")), w="kdl-055w")[0].asDict() == {"word": "kdl-055w", "number": "55", "letters": "kdlw"}
    assert one(spark, words(F.col("t")), t=" a  b\tc ") == ["a", "b", "c"]
    assert one(spark, plain_title(F.col("t")), t="The a&b and-c/d or Andy") == "a b c d Andy"


def test_qgrams(spark):
    assert one(spark, S.qgram_similarity(F.col("a"), F.col("b")), a="abc", b="abc") == 0.5
    assert one(spark, S.qgram_similarity(F.col("a"), F.col("b")), a="", b="") == 0.5


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("samsung un55es8000 55inch led hdtv", "samsung 55inch led hdtv un55es8000 black", 1.0), ("samsung un55es8000 55inch led", "lg 60ln5400 60inch plasma", None),
        ("sony kdl-55w802a tv", "sony bravia kdl55w802a 3d", 0.33), ("sharp lc70le", "sharp lc60le aquos set wide", 0.7816227766),
        ("vizio e320i smart", "vizio e320ia streaming player", None), ("coby hd", "coby panel unit", None),
    ],
)
def test_title(spark, a, b, want):
    def side(c):
        t = plain_title(F.col(c))
        found = T.model_words(t)
        return F.struct(F.array_distinct(words(t)).alias("words"), found.alias("model_words"), T.hybrids(found).alias("hybrids"))

    got = one(spark, S.title_similarity(side("a"), side("b"), Matching()), a=a, b=b)
    assert got == want if want is None else math.isclose(got, want, abs_tol=0.005 if want == 0.33 else 1e-9)


def test_signatures(spark):
    hashes = B.Hashes.of(60)
    rows = [(k, [(7 * k + j * j) % 60 for j in range(k % 5)]) for k in range(30)]
    got = {r.product_id: r.signature for r in B.signatures(spark.createDataFrame(rows, "product_id long, rows array<long>"), hashes).collect()}
    assert got == {k: [min(((a * r + b) % 30 for r in own), default=30) for a, b in zip(hashes.a, hashes.b)] for k, own in rows}
    assert B.Hashes.of(60, most=8).a == hashes.a[:8]
    none = B.signatures(spark.createDataFrame(rows, "product_id long, rows array<long>"), B.Hashes.of(0)).collect()
    assert all(r.signature == [] for r in none) and len(none) == 30


def test_plans(spark):
    """Queries read the columns they need, straight from the table."""
    plan = Q.shop_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan and "ExistingRDD" not in plan
    assert "p_retailprice" not in Q.gold_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([(0, 0, "a")], "row_id long, kind int, word string")
    incident = B.incidence(X.parts(spark, SF), words)
    sizes = [len(B.signatures(incident, B.Hashes.of(rows))._jdf.queryExecution().toString()) for rows in (40, 4000)]
    assert abs(sizes[0] - sizes[1]) < 500  # no coefficients in the plan


def test_bands():
    assert [B.bands(500, t) for t in (0.05, 0.2, 0.5, 0.7, 0.9)] == [(250, 2), (157, 3), (79, 6), (45, 11), (18, 27)]
    assert [B.bands(200, t) for t in (0.05, 0.2, 0.5, 0.7, 0.9)] == [(100, 2), (66, 3), (35, 5), (22, 9), (9, 21)]
    assert B.bands(4, 0.5) == (2, 2)
    assert B.Hashes.of(1000).a[0] == 7270 and B.Hashes.of(7).n == 4


def test_candidates(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randint(0, 2) for _ in range(12)]) for k in range(40)]
    rows += [(40 + k, rows[3][1]) for k in range(3)]
    signed = spark.createDataFrame(rows, "product_id long, signature array<long>")
    for t in (0.2, 0.5, 0.8):
        b, r = B.bands(12, t)
        want = {(x, y) for (x, s), (y, u) in itertools.combinations(rows, 2) if any(s[i * r : i * r + r] == u[i * r : i * r + r] for i in range(b))}
        assert {tuple(p) for p in B.candidates(signed, t, 12).collect()} == want
        assert {tuple(p)[1:] for p in B.sweep(signed, 12, (t, 0.4)).where(f"t = {t}").collect()} == want
        members = {}
        for x in B.buckets(signed, t, 12).collect():
            members.setdefault((x.band, tuple(x.part)), []).append(x.product_id)
        assert {p for m in members.values() for p in itertools.combinations(sorted(m), 2)} == want and all(len(m) > 1 for m in members.values())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)]
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "id_a long, id_b long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)


def slow_clusters(dist, n, epsilon):
    """Clusters that merge one after another, distances taken anew from all members each time."""
    d = lambda x, y: dist.get((min(x, y), max(x, y)), math.inf)
    clusters = {k: [k] for k in range(n)}
    queue = sorted((d(i, j), i, j) for i in range(n) for j in range(i + 1, n) if d(i, j) <= epsilon)
    pairs = set()
    while queue:
        _, i, j = queue.pop(0)
        if i not in clusters or j not in clusters or any(d(x, y) == math.inf for x in clusters[i] for y in clusters[j]):
            continue
        clusters[i] += clusters.pop(j)
        pairs |= {(min(p), max(p)) for p in itertools.combinations(clusters[i], 2)}
        for k in clusters:
            if k != i and (least := min(d(x, y) for x in clusters[i] for y in clusters[k])) <= epsilon:
                queue.append((least, i, k))
        queue.sort()
    return pairs


def test_merges():
    rng = random.Random(3)
    for case in range(300):
        n = rng.randint(2, 11)
        dist = {(i, j): rng.choice([0.1, 0.2, 0.3, 0.6]) if case % 2 else rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.7}
        for epsilon in (0.2, 0.5, 0.9):
            members, pairs = {}, set()
            for into, merged, height in C.merges([(i, j, d) for (i, j), d in dist.items()], 0.9):
                a, b = members.pop(into, [into]), members.pop(merged, [merged])
                members[into] = a + b
                if height <= epsilon:
                    pairs |= {(min(x, y), max(x, y)) for x in a for y in b}
            assert pairs == slow_clusters(dist, n, epsilon)


def test_cluster_sweep(spark):
    rng = random.Random(8)
    dist = {(i, j): round(rng.random(), 2) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.25}
    df = spark.createDataFrame([(i, j, d) for (i, j), d in dist.items()], "id_a long, id_b long, dist double")
    rows = C.cluster_sweep(df, (0.1, 0.3, 0.6)).collect()
    for e in (0.1, 0.3, 0.6):
        assert {(r.id_a, r.id_b) for r in rows if r.epsilon == e} == slow_clusters(dist, 30, e)
    assert C.dendrogram(df, 0.6).count() > 0


def test_like_brand_and_size(spark):
    own = P.prepared(X.parts(spark, SF), P.brands(X.raw_parts(spark, SF))).persist()
    rows = own.collect()
    pairs = [(a, b) for a, b in itertools.combinations(sorted(rows, key=lambda r: r.product_id), 2)]
    want = {(a.product_id, b.product_id) for a, b in pairs if a.brand is None or b.brand is None or a.brand == b.brand}
    got = [tuple(r) for r in Q._ids(P.like_brand(own)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    want = {(a.product_id, b.product_id) for a, b in pairs if any(abs(x - y) < 1 for x in a.sizes for y in b.sizes)}
    got = [tuple(r) for r in Q._ids(P.like_size(own)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    both = {p for p in want if (lambda a, b: a.brand is None or b.brand is None or a.brand == b.brand)(*({r.product_id: r for r in rows}[i] for i in p))}
    got = [tuple(r) for r in Q._ids(P.like_size(own, of_brand=True)).collect()]
    assert len(got) == len(set(got)) and set(got) == both
    attributes = P.distances(P.like_size(own), Matching(gamma=0.3)).collect()
    assert len(attributes) == len(want) and all(r.dist is not None for r in attributes)


def test_metrics(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "id_a long, id_b long")
    got = E.agreement(pairs((1, 2), (1, 3), (2, 3)), pairs((1, 2), (4, 5)), spark.range(5)).first()
    assert (got.pair_quality, got.pair_completeness, got.f1, got.frac_comparisons) == (1 / 3, 0.5, 0.4, 0.3)
    none = E.agreement(pairs((1, 2)).where("false"), pairs((1, 2)).where("false")).first()
    assert (none.pair_quality, none.pair_completeness, none.f1) == (0, 0, 0)
    assert [tuple(r) for r in E.averaged(spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 0.0)], "bootstrap long, t double, f1 double"), "t", "f1").collect()] == [(0.5, 0.5)]
    assert E.run_times(spark.createDataFrame([("x", 1.0), ("x", 3.0)], "method string, seconds double")).first()["std"] == 1.0


def test_sampling(spark):
    assert R.draws(1624, 0)[:6] == [1534, 1389, 1406, 1346, 1122, 1041]
    products = X.parts(spark, SF)
    drawn = R.train(products, 2)
    n = products.count()
    ids = [products.orderBy("product_id").collect()[p].product_id for p in dict.fromkeys(R.draws(n, 2))]
    assert [r.product_id for r in drawn.orderBy("sample_pos").collect()] == ids and "model_id" not in drawn.columns
    assert R.out_of_bag(products, drawn).count() == n - len(ids)
    gold = E.gold_pairs(products)
    drawn_ids = set(ids)
    want = {tuple(p) for p in gold.collect() if p.id_a in drawn_ids and p.id_b in drawn_ids}
    assert {tuple(p) for p in E.restricted(gold, drawn).collect()} == want
    assert [r.position for r in X.positioned(drawn, "sample_pos").orderBy("sample_pos").collect()] == list(range(1, len(ids) + 1))
    assert 0.5 < R.train_hashed(products).count() / n < 0.75


def test_numbered(spark):
    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(7), "v", name="k", start=5).collect()
    assert all(r.k == r.v + 5 for r in rows) and len(rows) == 1000


def test_json(spark, tmp_path):
    data = {"m2": [{"title": "B 5 Inch", "shop": "s", "modelID": "m2", "featuresMap": {"Brand": "X", "n": 3}}], "m1": [{"title": "A", "shop": "t", "featuresMap": {}}, {"title": "C", "shop": "u", "modelID": "m1", "featuresMap": {}}]}
    (tmp_path / "all.json").write_text(json.dumps(data, indent=1))
    raw = X.read_merged(spark, f"{tmp_path}/all.json")
    rows = raw.orderBy("product_id").collect()
    assert [(r.product_id, r.model_id, r.title) for r in rows] == [(1, "m2", "B 5 Inch"), (2, "m1", "A"), (3, "m1", "C")] and rows[0].features == {"Brand": "X", "n": "3"}
    assert sorted(r.key for r in X.merged_keys(spark, f"{tmp_path}/all.json").collect()) == ["m1", "m2"]
    products = X.cleaned(raw)
    assert products.where("product_id = 1").first().title == "b 5inch" and X.first(products, 2).count() == 2
    X.write_list(products, f"{tmp_path}/list")
    back = spark.read.schema(f"uniqueProductID long, {X.RECORD}").json(f"{tmp_path}/list")
    assert back.count() == 3
    (tmp_path / "list.json").write_text(json.dumps([{"uniqueProductID": 4, "title": "x", "shop": "s", "modelID": "m", "featuresMap": {"a": "b"}}]))
    assert X.read_list(spark, f"{tmp_path}/list.json").first().asDict() == {"product_id": 4, "model_id": "m", "shop": "s", "title": "x", "features": {"a": "b"}}
    (tmp_path / "words.json").write_text('["a", "b"]')
    assert [r.word for r in X.read_words(spark, f"{tmp_path}/words.json").collect()] == ["a", "b"]
    (tmp_path / "dup.json").write_text('{"1": [2, 3], "2": [1, 3]}')
    pairs = X.read_duplicates(spark, f"{tmp_path}/dup.json")
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]
    X.write_duplicates(pairs, f"{tmp_path}/dups")
    assert spark.read.json(f"{tmp_path}/dups").count() == 3
    assert sorted(map(tuple, X.read_partners(spark, f"{tmp_path}/dups").collect())) == [(1, 2), (1, 3), (2, 3)]
    assert X.read_lines(spark, f"{tmp_path}/list").count() == 3
    X.write_words(spark.createDataFrame([("b",), ("a",)], "word string"), f"{tmp_path}/vocabulary")
    assert [r.value for r in spark.read.text(f"{tmp_path}/vocabulary").collect()] == ["a", "b"]
    X.write_by_bootstrap(pairs.withColumn("bootstrap", F.lit(1)), f"{tmp_path}/boot")
    assert X.read_bootstraps(spark, f"{tmp_path}/boot").count() == 3


def test_experiments(spark):
    """Means over bootstraps against the runs one by one."""
    gold = {tuple(p) for p in E.gold_pairs(X.parts(spark, SF)).collect()}
    f1 = []
    for k in range(Q.BOOTSTRAPS):
        own = Q._prepared(Q._drawn(spark, SF, k), X.raw_parts(spark, SF))
        dist = {(r.id_a, r.id_b): r.dist for r in P.msmp_fast(own).collect()}
        names = sorted({i for p in dist for i in p})
        number = {v: i for i, v in enumerate(names)}
        found = slow_clusters({(number[a], number[b]): d for (a, b), d in dist.items()}, len(names), 0.7)
        found = {(min(names[i], names[j]), max(names[i], names[j])) for i, j in found}
        hit = len(found & gold)
        f1.append(2 * hit / (len(found) + len(gold)) if hit else 0.0)
    got = {r.epsilon: r.f1 for r in Q.fast_bootstraps(spark, SF).collect()}
    assert math.isclose(got[0.7], sum(f1) / len(f1), abs_tol=1e-6) and sorted(got) == [round(0.05 * k, 2) for k in range(1, 19)]


def test_names():
    assert not [n for n in Q.QUERIES if not re.fullmatch("[a-z0-9_]+", n)]
