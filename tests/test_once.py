"""Text steps run over distinct wordings, and lines are dealt once."""
import os

import pytest
from pyspark.sql import functions as F

from vacantia.operators import evidence as E
from vacantia.sources import listings as L

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_form_questions_are_classified_once_per_wording(spark):
    q = "questions array<struct<label:string,required:boolean,fields:array<struct<name:string,type:string,values:array<struct<label:string,value:string>>>>>>"
    one, two = ("Gender ", True, [("g", "input_text", None)]), ("Resume", None, [("r", "input_file", None), ("t", "textarea", None)])
    d = spark.createDataFrame([(1, [one, two]), (2, [one, (None, None, None)]), (3, None)], "posting_id bigint, " + q)
    out = L.flatten_form(d)
    assert "RLIKE" not in plan(out).upper()
    rows = {(r.posting_id, r.position): (r.label, r.label_key, r.required, r.answerability, [f.kind for f in r.fields]) for r in out.collect()}
    assert rows[1, 0] == rows[2, 0] == ("Gender", "gender", True, "demographic", ["short_text"])
    assert rows[1, 1] == ("Resume", "resume", False, "file", ["file", "long_text"])
    assert rows[2, 1][:1] == ("",) and len(rows) == 4


def test_equal_rewordings_are_checked_once(spark):
    b = spark.createDataFrame([(i, "Led 5 units of red widget" if i else None) for i in range(4)], "bullet_id bigint, text string")
    p = b.select("bullet_id", F.lit(1).alias("ord"), F.when(F.col("bullet_id") == 3, " ").otherwise("Ran 5 units of red widget").alias("proposal"), F.lit(" ok ").alias("why"))
    out = E.triage_proposals(p, b, ("red widget",))
    assert "ARRAY_EXCEPT" not in plan(out).upper()
    assert {(r.bullet_id, r.verdict, r.why) for r in out.collect()} == {(0, "discarded", "ok"), (1, "suggested", "ok"), (2, "suggested", "ok")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_lines_are_dealt_by_candidate_once(spark):
    from vacantia.catalog import evidence as C

    out = E.tailor_bullets(C._lines(spark, SF), C._asks(spark, SF))
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(candidate_id") + physical.count("Exchange hashpartitioning(o_custkey") <= 1
    assert "hashpartitioning(text" not in physical
