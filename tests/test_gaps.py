"""Gap reports by classes of keys: the same rows as by keys, and no candidate x key rows."""
from pyspark.sql import functions as F

from vacantia.operators import stats as A


def corpus(spark, n_keys=40):
    rows = [(f"have you worked with part {i}", "bank", "bank", 1000 - i, 1, None, f"L{i}") for i in range(n_keys)]
    rows += [(f"other {i}", "bank", "bank", 500 + i, 0, None, f"O{i}") for i in range(8)]
    rows += [("email", "profile", "profile", 9, 0, "email", "Email"), ("work email", "profile", "profile", 8, 0, "email", "Work"),
             ("phone", "profile", "profile", 7, 0, "phone", "Phone"), ("gender", "demographic", "yours", 5, 0, None, "Gender"), ("cv", "file", "skip", 5, 0, None, "CV")]
    return spark.createDataFrame(rows, "label_key string, answerability string, route string, n bigint, required_count bigint, profile_field string, label string")


def bank(spark):
    rows = [(1, 0, ["other 3", "not asked"], ["have you worked"]), (2, 0, [], ["part 1", "have you worked"]), (2, 1, ["other 3"], []), (3, 0, [], ["other"])]
    return spark.createDataFrame(rows, "candidate_id bigint, ord int, label_keys array<string>, label_patterns array<string>")


def people(spark):
    d = spark.createDataFrame([(1, "a@b.c"), (2, None), (3, None), (4, ""), (5, "x@y.z"), (5, "x@y.z"), (None, "n@n.n")], "candidate_id bigint, email string")
    for c in ("first_name", "last_name", "phone", "location", "city", "state", "country", "linkedin", "current_title", "resume_name"):
        d = d.withColumn(c, F.lit(None).cast("string"))
    return d.withColumn("years_experience", F.lit(None).cast("int"))


def test_candidates_meet_classes_and_not_keys(spark):
    c = corpus(spark)
    classes, reached = A.answer_classes(c, bank(spark))
    # 29 parts by one pattern, 11 by two, one key by text and pattern, seven by a pattern
    assert classes.count() == 48 and classes.select("cls").distinct().count() == 4
    assert reached.groupBy("candidate_id").count().collect() and reached.count() == 3 + 3 + 2
    keys = {(r.candidate_id, r.label_key) for r in A.corpus_answers(c, bank(spark)).collect()}
    parts = {f"have you worked with part {i}" for i in range(40)}
    assert keys == {(1, k) for k in parts | {"other 3"}} | {(2, k) for k in parts | {"other 3"}} | {(3, f"other {i}") for i in range(8)}


def test_gap_reports_are_alike_by_class_and_by_key(spark):
    c, p, b = corpus(spark), people(spark), bank(spark)
    classes, reached = A.answer_classes(c, b)
    answers = A.corpus_answers(c, b)
    for limit in (3, 60):
        by_class = A.gap_report(c, p, reached, limit, classes).collect()
        assert sorted(map(str, by_class)) == sorted(map(str, A.gap_report(c, p, answers, limit).collect())), limit
    shown = {k: [r.label_key for r in sorted(by_class, key=lambda r: r.gap_rank) if (r.candidate_id, r.kind) == k] for k in {(r.candidate_id, r.kind) for r in by_class}}
    assert shown[1, "bankable"] == [f"other {i}" for i in (7, 6, 5, 4, 2, 1, 0)] and shown[1, "profile"] == ["phone"]
    assert shown[3, "bankable"] == [f"have you worked with part {i}" for i in range(40)] and shown[3, "profile"] == ["email", "work email", "phone"]
    # rows of one candidate_id share its places, each gap once a row
    assert shown[5, "yours"] == ["gender"] * 2 and shown[None, "profile"] == ["email", "work email", "phone"]
    reach = {r.candidate_id: tuple(r)[1:] for r in A.gap_reach(c, p, reached, classes).collect()}
    assert reach == {r.candidate_id: tuple(r)[1:] for r in A.gap_reach(c, p, answers).collect()}
    total = sum(1000 - i for i in range(40)) + sum(500 + i for i in range(8))
    assert reach[1] == (7, sum(500 + i for i in range(8) if i != 3)) and reach[4] == (24, total)


def test_corpus_gaps_of_rows_and_of_counted_wordings(spark):
    rows = [("Email *", "short_text", True), ("Email *", "short_text", False), ("Email", "short_text", False), ("Notice period", "short_text", True),
            ("Notice period", "long_text", False)]
    raw = spark.createDataFrame(rows, "label string, kinds string, required boolean")
    labels = A.label_counts(raw)
    by_row = raw.join(labels.select("label", "kinds", "label_key", "answerability"), ["label", "kinds"])
    cols = ("label_key", "answerability", "n", "n_required", "route", "profile_field", "required_count", "label")
    assert sorted(map(str, A.corpus_gaps(labels).select(*cols).collect())) == sorted(map(str, A.corpus_gaps(by_row).select(*cols).collect()))
    assert {(r.label_key, r.n, r.required_count, r.label) for r in A.corpus_gaps(labels).collect()} == {
        ("email", 3, 1, "Email *"), ("notice period", 1, 1, "Notice period")}
