"""Reading and writing of products, word lists and pairs.

Products: product_id long, model_id string, shop string, title string, features map<string,string>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, clean_map
from ..operators.numbering import numbered

RECORD = "title string, shop string, modelID string, featuresMap map<string,string>"


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of model ids to lists of products, in file order, as raw products."""
    text = spark.read.text(path, wholetext=True)
    models = text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,array<struct<{RECORD.replace(' string', ':string').replace(' map<', ':map<')}>>>"))).alias("k", "e"))
    items = models.select("k", F.col("e.key").alias("key"), F.posexplode("e.value").alias("j", "p"))
    rows = items.select("k", "j", F.coalesce("p.modelID", "key").alias("model_id"), "p.shop", "p.title", F.col("p.featuresMap").alias("features"))
    return numbered(rows, "k", "j", name="product_id", start=1).select("product_id", "model_id", "shop", "title", "features")


def merged_keys(spark: SparkSession, path: str) -> DataFrame:
    """The top-level keys of what read_merged reads: the models that it lists, each once."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.json_object_keys("value")).alias("key")).distinct()


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of products, which have uniqueProductID; ones without are numbered in no given order."""
    rows = spark.read.json(path, multiLine=True, schema=f"uniqueProductID long, {RECORD}")
    return rows.select(F.col("uniqueProductID").alias("product_id"), F.col("modelID").alias("model_id"), "shop", "title", F.col("featuresMap").alias("features"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_list wrote: a product a line, so a folder of any size is read in parallel."""
    rows = spark.read.json(path, schema=f"uniqueProductID long, {RECORD}")
    return rows.select(F.col("uniqueProductID").alias("product_id"), F.col("modelID").alias("model_id"), "shop", "title", F.col("featuresMap").alias("features"))


def read_words(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """A JSON list of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias(name))


def read_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of ids to lists of ids, as pairs id_a < id_b."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("key", "others"))
    pairs = rows.select(F.col("key").cast("long").alias("a"), F.explode("others").alias("b"))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def read_partners(spark: SparkSession, path: str) -> DataFrame:
    """What write_duplicates wrote, as pairs id_a < id_b."""
    rows = spark.read.json(path, schema="id long, duplicates array<bigint>").select("id", F.explode("duplicates").alias("other"))
    return rows.where("id < other").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))


def positioned(rows: DataFrame, order: str) -> DataFrame:
    """rows with position: 1, 2, ... in that order, by which lists without ids name their products."""
    return numbered(rows, order, name="position", start=1)


def write_list(products: DataFrame, path: str) -> None:
    """Products as JSON lines in the field names of the lists."""
    products.select(F.col("product_id").alias("uniqueProductID"), "title", "shop", F.col("model_id").alias("modelID"), F.col("features").alias("featuresMap")).write.mode("overwrite").json(path)


def write_duplicates(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON lines of an id and its partners."""
    both = pairs.select("id_a", "id_b").union(pairs.select("id_b", "id_a"))
    both.groupBy(F.col("id_a").alias("id")).agg(F.array_sort(F.collect_set("id_b")).alias("duplicates")).write.mode("overwrite").json(path)


def write_words(words: DataFrame, path: str, name: str = "word") -> None:
    """A column of strings (a vocabulary, the brands), sorted, as text files of one each."""
    words.select(name).sort(name).write.mode("overwrite").text(path)


def write_by_bootstrap(rows: DataFrame, path: str) -> None:
    """Rows with a column bootstrap, as Parquet with a folder for each."""
    rows.write.mode("overwrite").partitionBy("bootstrap").parquet(path)


def read_bootstraps(spark: SparkSession, path: str) -> DataFrame:
    """What write_by_bootstrap wrote, all folders there."""
    return spark.read.parquet(path)


def cleaned(raw: DataFrame) -> DataFrame:
    """Raw products with title and attributes in one form."""
    return raw.withColumn("title", clean(F.col("title"))).withColumn("features", clean_map(F.col("features")))


def alike(raw: DataFrame) -> DataFrame:
    """raw with one row, named by its least id, for products of one shop, title and attributes: all that is made of them is made once.

    ids: all of them that are within one million ids, so that no row gathers more.
    """
    entries = raw.select("product_id", "shop", "title", F.map_entries("features").alias("entries"), F.shiftright("product_id", 20).alias("far"))
    found = entries.groupBy("shop", "title", "entries", "far").agg(F.min("product_id").alias("product_id"), F.collect_list("product_id").alias("ids"))
    return found.select("product_id", "ids", "shop", "title", F.map_from_entries("entries").alias("features"))


def first(products: DataFrame, n: int = 200) -> DataFrame:
    """The products of the first n ids."""
    return products.where(F.col("product_id") <= n)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least; one that has them is not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table part as raw products: units in several spellings, some without brand or size, some rich in attributes, some
    with their model in the title. Rows are few bytes and much work, so they are spread before anything is made of them."""
    return _raw(spread(spark.read.parquet(f"{sf_dir}/part.parquet")))


def alike_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What alike gives of raw_parts, but grouped by what products are made from before they are made: few bytes are shuffled.
    Rows that are alike only in what comes of them stay apart."""
    part, p = spread(spark.read.parquet(f"{sf_dir}/part.parquet")), F.col("p_partkey")
    more = F.when(p % 6 == 0, 0).when(p % 6 == 1, 1).when(p % 6 == 2, 2).when(p % 9 == 3, 3).otherwise(4)
    spelled = F.when(p % 4 == 0, 0).when(p % 4 == 1, 1).when(p % 4 == 2, 2).otherwise(3)
    of = [more, spelled, *[F.coalesce(p % k == 0, F.lit(False)) for k in (3, 7, 10, 11)], F.floor("p_retailprice"), F.shiftright(p + 1, 20)]
    found = part.groupBy("p_name", "p_brand", "p_type", "p_size", *[c.alias(f"of_{k}") for k, c in enumerate(of)])
    found = found.agg(F.min("p_partkey").alias("p_partkey"), F.min("p_retailprice").alias("p_retailprice"), F.collect_list(p + 1).alias("ids"))
    return _raw(found, "ids")


def _raw(part: DataFrame, *columns: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    spelled = F.when(p % 4 == 0, F.concat(size, F.lit("-Inch"))).when(p % 4 == 1, F.concat(size, F.lit('"'))).when(p % 4 == 2, F.concat(size, F.lit(" inches"))).otherwise(F.concat(size, F.lit("inch")))
    model = F.concat("p_name", F.lit("/"), "p_brand")
    more = F.when(p % 6 == 0, F.lit(" 120 Hz")).when(p % 6 == 1, F.lit(" 60-hertz")).when(p % 6 == 2, F.lit(" 25 pounds")).when(p % 9 == 3, F.concat(F.lit(" "), size, F.lit('-1/8"'))).otherwise(F.lit(""))
    more = F.concat(more, F.when(p % 11 == 0, F.concat(F.lit(" "), model)).otherwise(F.lit("")))
    usd = F.concat(F.floor("p_retailprice").cast("string"), F.lit("usd"))
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    features = F.concat(
        F.when(p % 7 != 0, F.array(entry("Brand", F.col("p_brand")))).otherwise(none),
        F.when(p % 10 != 0, F.array(entry("Screen Size", spelled))).otherwise(none),
        F.array(entry("Type", F.col("p_type")), entry("Retail Price", usd)),
        F.when(p % 3 == 0, F.array(*[entry(f"Note {k}", F.lit("yes")) for k in range(1, 20)])).otherwise(none),
    )
    return part.select(
        (p + 1).alias("product_id"), model.alias("model_id"),
        F.when(p % 4 == 0, "a.com").when(p % 4 == 1, "b.com").when(p % 4 == 2, "c.com").otherwise("shop.a.com").alias("shop"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(spelled, F.lit(" "), usd, more)).alias("title"),
        F.map_from_entries(features).alias("features"), *columns,
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(raw_parts(spark, sf_dir))
