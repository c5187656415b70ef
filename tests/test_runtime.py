from pyspark.sql import functions as F

from quire.operators.incremental import chunks
from quire.runtime import cut, cut_bucketed, numbered, release, spread


def test_numbering_is_global_and_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert [(r.k, r.place) for r in numbered(df, "k").orderBy("place").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(df, F.desc("k")).where("k = 999").first().place == 1 and numbered(df.limit(0), "k").count() == 0
    assert {(r.chunk, r.place) for r in chunks(spark.range(5), ["id"], 2).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}


def test_cuts(spark):
    df = spark.range(20).select("id", F.array("id").alias("a"), F.lit(None).cast("string").alias("n"))
    kept = cut(df)
    assert kept.columns == df.columns and kept.count() == 20
    by = cut_bucketed(df, "id")
    assert "Exchange" not in by.groupBy("id").count()._jdf.queryExecution().executedPlan().toString() and by.count() == 20
    release(kept)
    assert spread(spark.range(1).coalesce(1)).rdd.getNumPartitions() >= 2
