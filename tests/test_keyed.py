from pyspark.sql import functions as F

from skyweave.operators import keyed
from skyweave.operators.keyed import latest, lookup_join


def test_latest_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0), (1, "b", 4.0), (1, "b", 9.0), (1, "b", 9.0), (2, None, 1.0), (None, "a", 3.0), (None, "b", None)], "k int, at string, v double"
    )
    got = {(r.k, r.at, r.v) for r in latest(df, ["k"], "at", ["v"]).collect()}
    assert got == {(1, "b", 9.0), (2, None, 1.0), (None, "b", None)}
    assert latest(df.limit(0), ["k"], "at").count() == 0


def test_lookup_join_of_heavy_keys_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HEAVY_ROWS", 10)
    monkeypatch.setattr(keyed, "HEAVY_KEYS", 5)
    left = spark.range(300).select(F.when(F.col("id") < 100, 0).when(F.col("id") == 299, None).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("v"))
    right = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("left", "inner"):
        a = sorted(lookup_join(left, right, "k", how).collect(), key=str)
        assert a == sorted(left.join(right, "k", how).collect(), key=str)


def test_lookup_join_names_the_left_side_once_unless_keys_are_heavy(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HEAVY_ROWS", 10)
    monkeypatch.setattr(keyed, "HEAVY_KEYS", 5)
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    named = lambda df: df._jdf.queryExecution().analyzed().toString().count("Range (0, 301")
    even, one = (spark.range(301).select(k.alias("k"), F.col("id").alias("v")) for k in (F.col("id"), F.lit(7)))
    for left in (even, one):
        for how in ("left", "inner"):
            got = lookup_join(left, right, "k", how)
            assert named(got) == 1
            assert sorted(got.collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
