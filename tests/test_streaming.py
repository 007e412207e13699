import json

from pyspark.sql import functions as F

from pairloom.streaming.products import first_arrivals, matched, read_stream


def test_stream(spark, tmp_path):
    rows = [{"product_id": k % 3, "model_id": "m", "shop": "s", "title": f"TV {k % 3} Inch", "features": {"A": "1 Hz"}, "arrived": "2024-01-01T00:00:00Z"} for k in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = first_arrivals(read_stream(spark, f"{tmp_path}/in"))
    writer = matched(stream, lambda batch: batch.groupBy("title").agg(F.count("*").alias("n")), f"{tmp_path}/out", f"{tmp_path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.title, r.n) for r in found) == [("tv 0inch", 1), ("tv 1inch", 1), ("tv 2inch", 1)]
