"""What the jobs keep on disk: shuffle files of stored tables, how often a table is built, what lines carry."""

import glob
import os
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia import catalog
from vacantia.catalog import forms
from vacantia.catalog import tables as D
from vacantia.operators import planning as P
from vacantia.session import materialise


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.toString()}/*/shuffle_*.data")}


def test_shuffle_files_of_a_stored_table_go(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, had = shuffle_files(spark), spark.conf.get(conf)
    d = materialise(spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(conf) == had and d.count() == 999


def given(spark, path, lines, parts=(1, 2, 3), orders=(1, 2)):

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).withColumn("_", F.lit(0)).drop("_").write.parquet(f"{path}/{name}.parquet")

    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_returnflag string").select(
        "*", F.lit(7.0).alias("l_quantity"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("O").alias("l_linestatus"), D.now().alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")
    write("part", [(k, f"thing {k}", f"Brand#{k}", "T", k) for k in parts], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    write("orders", [(k, 10 + k, "5-LOW") for k in orders], "o_orderkey bigint, o_custkey bigint, o_orderpriority string")


def test_lines_are_numbered_by_all_columns_where_the_first_are_equal(spark, tmp_path):
    lines = [(1, 1, 2, 5, 9.0, "R"), (1, 1, 2, 5, 8.0, "A"), (1, 1, 2, None, 7.0, "N"), (1, 1, 1, 9, 1.0, "R"), (1, None, 3, 9, 1.0, "A"),
             (1, 2, 8, 1, 1.0, "N"), (2, 1, 3, 1, 1.0, "A"), (2, 1, 3, 1, 1.0, "R"), (None, 1, 1, 1, 1.0, "R"), (7, 1, 1, 1, 1.0, "R")]
    given(spark, tmp_path, lines, parts=(1, 2, 3, 3))  # part 8 is not there, part 3 is there twice
    w = Window.partitionBy("l_orderkey").orderBy(*D.LINE_ORDER)
    want = D.lines(spark, str(tmp_path)).select("l_orderkey", "l_partkey", "l_returnflag", F.row_number().over(w).alias("line"))
    got = D.numbered(spark, str(tmp_path), "l_partkey", "l_returnflag")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    window = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x)
    assert "_rest" in window and "l_tax" not in window


@pytest.mark.parametrize("name", ["kit", "kit_counts", "run_row", "worklist_totals", "plan_counts", "plan_summary"])
def test_questions_are_stored_once_a_query(spark, name, monkeypatch):
    sf, calls, real = "/root/testdata/sf0.001", [], D.questions
    if not os.path.isdir(sf):
        pytest.skip("test tables are not there")
    monkeypatch.setattr(D, "questions", lambda *a: calls.append(1) or real(*a))
    catalog.queries()[name](spark, sf)
    assert len(calls) == 1


def test_kit_works_the_plan_out_once(spark):
    acts = spark.createDataFrame([("c", "p", 0, 0, "CV", "cv", True, "file", None, None), ("c", "p", 1, 0, "Name", "n", True, "profile", "Ada", None),
                                  ("d", "q", 0, 0, "CV", "cv", True, "file", None, None), (None, "p", 0, 0, "CV", "cv", True, "file", None, None)],
                                 "candidate_id string, posting_id string, position int, field_no int, label string, field_name string, required boolean, "
                                 "source string, value string, reason string").withColumn("_n", F.explode(F.array(F.lit(1)))).drop("_n")
    docs = spark.createDataFrame([("c", "a.pdf"), ("c", "b.pdf")], "candidate_id string, resume_name string")
    sizes = spark.createDataFrame([("p", 4)], "posting_id string, form_fields bigint")
    k = P.kit(acts, docs, sizes)
    assert k._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    got = {r.candidate_id: r for r in k.collect()}
    assert set(got) == {"c", "d"}
    assert [(x.label, x.value) for x in got["c"].answers] == [("CV", "a.pdf"), ("CV", "b.pdf"), ("Name", "Ada"), ("Name", "Ada")]
    assert (got["c"].prepared, got["c"].stated, got["c"].coverage, got["c"].skipped_optional_blank) == (2, 2, 50, 2)
    assert [(x.label, x.source) for x in got["d"].open_items] == [("CV", "unresolved")] and got["d"].coverage is None


def test_a_plan_sends_no_wording_through_its_shuffles(spark, tmp_path):
    given(spark, tmp_path, [(1, 1, 1, 1, 1.0, "R"), (1, 2, 2, 1, 1.0, "A"), (2, 1, 3, 1, 1.0, "R")])
    spark.createDataFrame([(11, "A#1", 1, 1.0, "BUILDING"), (12, "A#2", 1, -1.0, "BUILDING")],
                          "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    plan = forms._plan(spark, str(tmp_path))
    assert plan.count() >= 2
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # the profile's values are looked up before a question is met: no row of a question holds the map
    assert "_values" in text and text.index("_values") > text.index("posexplode")


@pytest.mark.parametrize("name", ["match_plan_to_page", "unplanned_page_fields"])
def test_page_fields_read_the_lines_once(spark, tmp_path, name):
    given(spark, tmp_path, [(1, 1, 1, 1, 1.0, "R"), (1, 2, 2, 1, 1.0, "A"), (2, 1, 3, 1, 1.0, "R")])
    d = catalog.queries()[name](spark, str(tmp_path))
    assert "l_linenumber" not in d._jdf.queryExecution().executedPlan().toString() and d.count() >= 0


def test_alerts_deal_their_pairs_once(spark, monkeypatch, tmp_path):
    from vacantia.streaming import jobs as J

    hits = spark.range(50).select((F.col("id") % 7).alias("search_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("posting_id"))
    monkeypatch.setattr(J, "search_alerts", lambda *a: hits.unionByName(hits))
    batch, plans = hits.select("posting_id"), []
    real = type(hits).join

    def join(self, other, *a, **k):
        out = real(self, other, *a, **k)
        if a[-1:] == ("left_anti",):
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(hits), "join", join)
    monkeypatch.setattr(J, "sent_alerts", lambda *a: hits.where("search_id < 3").select("search_id", "posting_id", F.lit(0).cast("bigint").alias("batch"), J._part_of().alias("part")).limit(40))
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        J.alerts_batch(f"{tmp_path}/ledger", lambda _: hits, F.lit(None))(batch, 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == hits.where("search_id >= 3").count()
    assert "SortMergeJoin" in plans[0] and "hashpartitioning(search_id" not in plans[0]
