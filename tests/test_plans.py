"""What Spark plans with: sizes of tables in files, and where Python runs."""

from pyspark.sql import functions as F

from vacantia.catalog import tables as D
from vacantia.operators import stats as A


def test_size_of_a_compressed_table_is_not_its_size_on_disk(spark, tmp_path):
    had = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    path = f"{tmp_path}/customer.parquet"
    spark.range(400_000).select("id", F.lit("a name that repeats").alias("c_name")).coalesce(1).write.parquet(path)
    try:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
        d = D.read(spark, str(tmp_path), "customer").groupBy("id").agg(F.max("c_name").alias("n"))
        plan = spark.range(100).join(d, "id", "left")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "3.0")  # the session's own figure stays
        D.read(spark, str(tmp_path), "customer")
        assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "3.0"
    finally:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", had)


def test_patterns_visit_python_once_each(spark):
    bank = spark.range(50).select(F.col("id").alias("candidate_id"), F.lit(0).alias("ord"), F.expr("array('sponsor', '([')").alias("label_patterns"))
    d = A.screen_patterns(bank)
    assert "EvalPython" not in d._jdf.queryExecution().executedPlan().toString()  # not once per entry
    assert {tuple(r.label_patterns) for r in d.collect()} == {("sponsor",)}
