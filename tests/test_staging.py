"""Staged tables say how large their rows are, not how well their files compress."""

from pyspark.sql import functions as F

from weftgraph import staging


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repetitive_rows_are_not_taken_for_a_small_table(spark, monkeypatch):
    monkeypatch.setattr(staging, "SMALL_FILES", 1 << 10)
    rows = spark.range(60000).select(
        "id", F.lit("pkg/orders/__init__.py").alias("path"), F.lit("import").alias("fact"))
    staged, plain = staging.stage(rows, "sized"), staging.stage_as_is(rows, "plain")
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size(plain) < 60000 * 28 <= size(staged)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size(plain) + 1))
    try:
        large = spark.range(10**9).withColumn("x", F.lit("x"))
        assert "BroadcastHashJoin" in _plan(large.join(plain, "id"))
        assert "BroadcastHashJoin" not in _plan(large.join(staged, "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert staged.sparkSession is rows.sparkSession and staged.columns == rows.columns
    assert staged.join(plain, "id").count() == 60000
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"


def test_small_tables_and_partitions_read_back_whole(spark, monkeypatch):
    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("part"), F.lit("x" * 200).alias("text"))
    for least in (0, 1 << 30):
        monkeypatch.setattr(staging, "SMALL_FILES", least)
        staged = staging.stage(rows, "parts", ["part"])
        assert staged.dtypes == rows.dtypes
        assert staged.filter("part = 1").agg(F.count("*"), F.sum("id")).first() == rows.filter(
            "part = 1").agg(F.count("*"), F.sum("id")).first()


def test_given_tables_are_sized_by_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "SMALL_FILES", 1 << 10)
    rows = spark.range(60000).select("id", F.lit("customer").alias("name"))
    rows.write.parquet(f"{tmp_path}/given.parquet")
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    given, plain = (f(spark, str(tmp_path), "given") for f in (staging.table, staging.table_as_is))
    assert size(plain) < 60000 * 28 <= size(given)
    assert given.schema == plain.schema and given.exceptAll(plain).isEmpty() and given.count() == 60000
