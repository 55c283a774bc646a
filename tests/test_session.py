"""Session helpers: checked joins, parallelism, checkpoints, package shipping."""

from pyspark.sql import functions as F

from polysafe.session import checkpoint_dir, cut_lineage, ensure_parallel, join_checked


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_join_checked_broadcasts_small_and_shuffles_large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(10_000).withColumn("g", F.col("id") % 5)
        small = big.groupBy("g").agg(F.count("*").alias("n"))
        assert "BroadcastHashJoin" in _plan(join_checked(big, small, "g", max_bytes=10_000))
        assert "BroadcastHashJoin" not in _plan(join_checked(big, small, "g", max_bytes=20))
        assert "BroadcastHashJoin" not in _plan(join_checked(big, small, "g"))  # the session allows none
        assert join_checked(big, small, "g", max_bytes=20).count() == 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_ensure_parallel(spark):
    wide = spark.range(0, 1000, numPartitions=64)
    assert ensure_parallel(wide) is wide                     # several splits: untouched, no shuffle
    assert ensure_parallel(wide.coalesce(2), 8).rdd.getNumPartitions() == 2
    narrow = spark.range(0, 1000, numPartitions=1)
    spread = ensure_parallel(narrow, 8)
    assert spread.rdd.getNumPartitions() == 8
    assert sorted(r[0] for r in spread.collect()) == list(range(1000))


def test_checkpoint_dir_kept_and_lineage_cut(spark):
    d = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == d                        # an existing setting is never replaced
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "LogicalRDD" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.agg(F.sum("x")).first()[0] == 90


def test_entry_schema_stable(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [
        ("model", "string"), ("prompt_type", "string"), ("language", "string"), ("language_response", "string"),
        ("refusal", "double"), ("over_refusal", "double"), ("uncertain_harmful", "double"),
        ("uncertain_harmless", "double")]
