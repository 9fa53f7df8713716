import pytest
from pyspark.sql import functions as F

from sievelake.operators.salted import heavy_hashes, salted_aggregate, salted_top_per_key, with_share

AGGS = {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "d": ("count_distinct", "w")}


def skewed(spark, n=6000):
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 11).cast("double")).alias("v"), (F.col("id") % 13).alias("w"), F.lit(1).alias("__salt"))
    return df.unionAll(df.limit(500))


def plain(df):
    return df.groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("nv"), F.sum("v").alias("s"), F.avg("v").alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct("w").alias("d"))


def as_set(df):
    return {tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


def test_equals_plain_aggregation(spark):
    df = skewed(spark)
    got = salted_aggregate(df, ["k"], AGGS, salts=8)
    assert as_set(got) == as_set(plain(df).select(*got.columns))


def test_random_salts_without_distinct(spark):
    df, aggs = skewed(spark), {k: v for k, v in AGGS.items() if k != "d"}
    got = salted_aggregate(df, ["k"], aggs)
    assert as_set(got) == as_set(plain(df).select(*got.columns))


def test_heavy_key_is_found_and_spread(spark):
    df = skewed(spark)
    hot = df.where("k = 'hot'").select(F.xxhash64("k")).first()[0]
    assert hot in heavy_hashes(df, ["k"], 0.2)


def test_empty_and_all_null(spark):
    df = skewed(spark)
    assert salted_aggregate(df.limit(0), ["k"], AGGS).count() == 0
    nulls = df.select(F.lit(None).cast("string").alias("k"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("long").alias("w")).limit(5)
    r = salted_aggregate(nulls, ["k"], AGGS).collect()
    assert [tuple(x) for x in r] == [(None, 5, 0, None, None, None, None, 0)]


def test_share_and_errors(spark):
    counts = salted_aggregate(skewed(spark), ["k"], {"n": ("count", None)})
    assert abs(with_share(counts, "n", "share").agg(F.sum("share")).first()[0] - 1) < 1e-9
    with pytest.raises(ValueError):
        salted_aggregate(skewed(spark), ["k"], {"k": ("count", None)})
    with pytest.raises(ValueError):
        salted_aggregate(skewed(spark), ["k"], {"a": ("count_distinct", "v"), "b": ("count_distinct", "w")})
    with pytest.raises(ValueError):
        salted_aggregate(skewed(spark), ["k"], {"a": ("median", "v")})


def test_top_per_key_in_two_stages(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("x").alias("k"), "id")
    got = sorted(tuple(r) for r in salted_top_per_key(df, ["k"], [F.desc("id")], 3).collect())
    assert got == [("hot", 2994), ("hot", 2996), ("hot", 2998), ("x", 2995), ("x", 2997), ("x", 2999)]
