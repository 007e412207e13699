"""Which pairs may be one product, and how far apart they are.

A pair that cannot be one product has no row; distances are for the others. Features of a product are made once,
not once a pair, and pairs come from equi-joins on what a pair must share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Matching
from ..functions import similarity as S
from ..functions import tokens as T
from ..functions.text import let, plain_title, words
from .blocking import bands
from .clustering import clustered
from .grids import Rule, by_brand, by_size
from .measures import Measure

DEFAULT = Matching()


def brands(raw: DataFrame) -> DataFrame:
    """(brand, n): lower-case brands of raw attributes, Brand or else Brand Name."""
    found = let(F.col("features"), lambda f: F.coalesce(F.nullif(f["Brand"], F.lit("")), F.nullif(f["Brand Name"], F.lit(""))))
    return raw.select(F.lower(found).alias("brand")).where("brand is not null").groupBy("brand").agg(F.count("*").alias("n"))


def prepared(products: DataFrame, known: DataFrame) -> DataFrame:
    """Each product's features that pairs are judged by. known: brand, the brands that count; its size is checked
    by Spark before it is broadcast. A column ids (of products that are alike) stays."""
    title, found = F.col("plain"), F.col("found")
    own = products.withColumn("plain", plain_title(F.col("title"))).withColumn("found", T.model_words(title)).select(
        "product_id", *(["ids"] if "ids" in products.columns else []), "shop", "features", F.size("features").alias("n_features"), T.brand(F.col("features")).alias("own_brand"),
        T.screen_sizes(F.col("features")).alias("sizes"), T.value_words(F.col("features")).alias("value_words"),
        F.struct(F.array_distinct(words(title)).alias("words"), found.alias("model_words"), T.hybrids(found).alias("hybrids")).alias("title"),
    )
    listed = known.select(F.col("brand").alias("brand")).distinct()
    return own.join(listed, own["own_brand"] == listed["brand"], "left").drop("own_brand")


def same_shop(a: Column, b: Column) -> Column:
    """One shop's name holds the other's; false if one is unknown."""
    return F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False))


def other_brand(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def other_size(a: Column, b: Column, gap: float = 1.0) -> Column:
    """No two sizes within the gap, or one side without sizes."""
    return ~F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) < gap)), F.lit(False))


def _sides(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    return own.select(F.struct("*").alias("a")), own.select(F.struct("*").alias("b"))


def like_brand(own: DataFrame) -> DataFrame:
    """(a, b) of products of one brand, or of which one's brand is unknown.

    A product of unknown brand meets all others: those are dealt out by a hash, and it goes to each hash's partition.
    """
    a, b = _sides(own.where("brand is not null"))
    known = a.join(b, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.product_id") < F.col("b.product_id")))
    deals = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = own.select(F.struct("*").alias("x"), F.pmod(F.xxhash64("product_id"), F.lit(deals)).cast("int").alias("deal"))
    many = own.where("brand is null").select(F.struct("*").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    first = F.col("x.product_id") < F.col("y.product_id")
    met = one.join(many, "deal").where(first | (F.col("x.brand").isNotNull() & (F.col("x.product_id") > F.col("y.product_id"))))
    return known.unionByName(met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b")))


def like_size(own: DataFrame, gap: float = 1.0, of_brand: bool = False) -> DataFrame:
    """(a, b) of products that have sizes within the gap: filed by whole gaps, met in the same and the next.

    of_brand: only those of one brand, or of which one's brand is unknown; products of a known brand then meet by brand too.
    """
    whole = F.array_distinct(F.transform("sizes", lambda s: F.floor(s / gap)))
    ids = own.select("product_id", "sizes", "brand", F.explode(whole).alias("k"))
    near = own.select(F.col("product_id").alias("other"), F.col("sizes").alias("others"), F.col("brand").alias("brand_b"), F.explode(F.array_distinct(F.flatten(F.transform(whole, lambda k: F.array(k - 1, k, k + 1))))).alias("k"))
    if of_brand:
        known = ids.join(near.withColumn("brand", F.col("brand_b")), ["k", "brand"]).select("k", "product_id", "sizes", "other", "others")
        loose = ids.where("brand is null").join(near, "k").unionByName(ids.where("brand is not null").join(near.where("brand_b is null"), "k"))
        joined = known.unionByName(loose.select(*known.columns))
    else:
        joined = ids.join(near, "k")
    met = joined.where("product_id < other").where(~other_size(F.col("sizes"), F.col("others"), gap))
    pairs = met.select(F.col("product_id").alias("id_a"), F.col("other").alias("id_b")).distinct()
    return of_pairs(own, pairs)


def of_pairs(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the features of given pairs id_a, id_b.

    Pairs are few bytes and much work, so they are dealt out by number, which Spark does not undo for their size.
    """
    a, b = _sides(own)
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(a, F.col("id_a") == F.col("a.product_id")).join(b, F.col("id_b") == F.col("b.product_id")).repartition(parts, "id_a", "id_b").select("a", "b")


def attribute_match(a: Column, b: Column, m: Matching) -> Column:
    """Struct (m, w, sim, keys_a, keys_b) over pairs of attributes whose keys are alike by more than gamma.

    A key that matches several counts each time and is taken away once.
    """
    start = F.struct(F.lit(0).alias("m"), F.lit(0.0).alias("w"), F.lit(0.0).alias("sim"), F.array().cast("array<string>").alias("keys_a"), F.array().cast("array<string>").alias("keys_b"))

    def grams(features: Column) -> Column:
        return F.transform(F.map_entries(features), lambda e: F.struct(e["key"].alias("key"), S.qgrams(e["key"], m.q).alias("k"), S.qgrams(e["value"], m.q).alias("v")))

    def add(t: Column, x: Column, y: Column) -> Column:
        def hit(key: Column) -> Column:
            return F.struct((t["m"] + 1).alias("m"), (t["w"] + key).alias("w"), (t["sim"] + key * S.shared_part(x["v"], y["v"])).alias("sim"), F.array_append(t["keys_a"], x["key"]).alias("keys_a"), F.array_append(t["keys_b"], y["key"]).alias("keys_b"))

        return let(S.shared_part(x["k"], y["k"]), lambda key: F.when(key > m.gamma, hit(key)).otherwise(t))

    return let(grams(b), lambda other: F.aggregate(grams(a), start, lambda t, x: F.aggregate(other, t, lambda u, y: add(u, x, y))))


def distances(pairs: DataFrame, m: Matching = DEFAULT, *, fast: bool = False) -> DataFrame:
    """(id_a, id_b, dist) of pairs (a, b) of prepared products.

    fast leaves the title out where both have more than m.rich attributes. Since key similarity is 0.5 at most,
    attributes are compared only for a smaller gamma.
    """
    a, b = F.col("a"), F.col("b")
    title = S.title_similarity(a["title"], b["title"], m)
    if fast:
        title = F.when((a["n_features"] > m.rich) & (b["n_features"] > m.rich), F.lit(None)).otherwise(title)
    found = pairs.withColumn("title", title)
    if m.gamma >= 0.5:
        share, mean, rest = F.lit(0.0), F.lit(0.0), S.jaccard(a["value_words"], b["value_words"])
    else:
        found = found.withColumn("match", attribute_match(a["features"], b["features"], m))
        match = F.col("match")
        share = F.coalesce(F.try_divide(match["m"], F.least(a["n_features"], b["n_features"])), F.lit(0.0))
        mean = F.coalesce(F.try_divide(match["sim"], match["w"]), F.lit(0.0))

        def without(features: Column, keys: Column) -> Column:
            return T.value_words(F.map_filter(features, lambda k, _: ~F.array_contains(keys, k)))

        rest = S.jaccard(without(a["features"], match["keys_a"]), without(b["features"], match["keys_b"]))
    plain = share * mean + (1 - share) * rest
    titled = (1 - m.mu) * share * mean + (1 - m.mu - (1 - m.mu) * share) * rest + m.mu * F.col("title")
    h = F.when(F.col("title").isNull(), plain).otherwise(titled)
    return found.select(F.col("a.product_id").alias("id_a"), F.col("b.product_id").alias("id_b"), (1 - h).alias("dist"))


def allowed(pairs: DataFrame, m: Matching = DEFAULT, *, fast: bool = False) -> DataFrame:
    """Pairs that neither share a shop nor differ in brand, nor (fast) in size."""
    a, b = F.col("a"), F.col("b")
    stay = ~same_shop(a["shop"], b["shop"]) & ~other_brand(a["brand"], b["brand"])
    return pairs.where(stay & ~other_size(a["sizes"], b["sizes"], m.size_gap) if fast else stay)


def msmp(own: DataFrame, candidates: DataFrame | None = None, m: Matching = DEFAULT, digits: int | None = None) -> DataFrame:
    """Distances of prepared products, of candidate pairs if given, else of all pairs that may be one product.

    All pairs are compared as matrices, unless gamma lets attributes match. digits: decimals kept, if given.
    """
    if candidates is None and m.gamma >= 0.5:
        return by_brand(own, Rule(shop=False, brand="like"), Measure("msmp", m, digits))
    return _decimals(distances(allowed(of_pairs(own, candidates) if candidates is not None else like_brand(own), m), m), digits)


def msmp_fast(own: DataFrame, candidates: DataFrame | None = None, m: Matching = DEFAULT, digits: int | None = None) -> DataFrame:
    """The same, but sizes must be alike and titles of rich products don't count."""
    if candidates is None and m.gamma >= 0.5:
        return by_size(own, Rule(shop=False, brand="like", gap=m.size_gap), Measure("fast", m, digits))
    pairs = of_pairs(own, candidates) if candidates is not None else like_size(own, m.size_gap, of_brand=True)
    return _decimals(distances(allowed(pairs, m, fast=True), m, fast=True), digits)


def fast_clusters(own: DataFrame, most: float, m: Matching = DEFAULT) -> DataFrame:
    """(id_a, id_b, height): pairs that share a cluster of msmp_fast's distances, for a gamma that no key reaches."""
    if m.gamma < 0.5:
        raise ValueError("attributes that match are compared pair by pair: give the distances of msmp_fast to paired")
    return clustered(own, Rule(shop=False, brand="like", gap=m.size_gap), Measure("fast", m, None), most)


def _decimals(found: DataFrame, digits: int | None) -> DataFrame:
    return found if digits is None else found.withColumn("dist", F.round("dist", digits))


def msmp_gated(own: DataFrame, t: float, n: int, m: Matching = DEFAULT, *, fast: bool = False, digits: int | None = None) -> DataFrame:
    """msmp (or msmp_fast) of the candidate pairs of LSH, for a gamma that no key reaches: own has signature, n numbers as bytes.

    Candidates are not listed: pairs of a block that share a band of their signatures are compared where they meet."""
    if m.gamma < 0.5:
        raise ValueError("attributes that match are compared pair by pair: give candidates to msmp")
    rule = Rule(shop=False, brand="like", gap=m.size_gap, bands=bands(n, t), numbers=n)
    return by_size(own, rule, Measure("fast", m, digits)) if fast else by_brand(own, rule, Measure("msmp", m, digits))
