import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["id_a", "id_b"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["clean_titles", "kvp_extended_words", "vocab_extended", "tmwm_similarity", "msmp_distance", "kvp_matching", "gold_pairs", "dataset_stats", "lsh_candidates", "lsh_small", "bootstrap_oob", "restricted_gold", "gold_round_trip"])
def test_oracles(spark, name):
    df = entry.queries()[name](spark, SF)
    with duckdb.connect() as db:
        db.sql(f"create view part as select * from '{SF}/part.parquet'")
        found = db.sql(entry.oracle_sql()[name])
        columns, rows = found.columns, found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(rows, key=str)
