"""Index state, lifecycles, streams against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from vacantia.operators import evidence as E
from vacantia.operators import index as X
from vacantia.operators import tracking as K
from vacantia.streaming import jobs as J

T0 = dt.datetime(2026, 5, 1)
TARGET = ("board string, external_id string, title string, closed_at timestamp, first_seen_at timestamp, fetched_at timestamp, "
          "form_fetched_at timestamp, form_readable boolean")


def test_upsert_and_close(spark):
    now = F.lit("2026-06-01").cast("timestamp")
    t = spark.createDataFrame([("a", "1", "old", T0, T0, T0, T0, True), ("a", "2", "old", None, T0, T0, None, None),
                               ("b", "3", "old", None, T0, T0, None, None), ("c", "4", "old", None, T0, T0, None, None)], TARGET)
    s = spark.createDataFrame([("a", "1", "new"), ("a", "9", "new")], "board string, external_id string, title string")
    st = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "board string, reached boolean")
    out = {(r.board, r.external_id): r for r in X.close_delisted(X.upsert_postings(t, s, now), s, st, now).collect()}
    assert out["a", "1"].closed_at is None and out["a", "1"].title == "new" and out["a", "1"].form_readable and out["a", "1"].first_seen_at == T0
    assert out["a", "2"].closed_at is not None and out["a", "9"].first_seen_at.month == 6
    assert out["b", "3"].closed_at is None and out["c", "4"].closed_at is None


def test_stale(spark):
    now = F.lit("2026-05-02").cast("timestamp")
    def stale(*rows):
        return X.index_is_stale(spark.createDataFrame(list(rows), "disabled boolean, last_fetched_at timestamp"), 23, now).first().stale
    assert stale((False, T0), (False, None)) is True and stale((False, T0 + dt.timedelta(hours=2)), (False, None)) is False
    assert stale((False, None)) is True and stale((True, None)) is False


def test_form_fetch(spark):
    f = spark.createDataFrame([(1, False, None), (2, True, None), (3, True, [])], "id int, reached boolean, questions array<string>")
    got = {r.id: r.form_readable for r in X.form_state_from_fetch(f, F.current_timestamp()).collect()}
    assert got == {2: False, 3: True}


def test_sent_record_is_written_once(spark):
    ev = spark.createDataFrame([(3, T0 + dt.timedelta(days=3), 1, "p", "APPLIED"), (1, T0, 1, "p", "SAVED"),
                                (2, T0 + dt.timedelta(days=1), 1, "p", "APPLIED"), (4, T0 + dt.timedelta(days=2), 1, "p", "SKIPPED")],
                               "event_id bigint, ts timestamp, candidate_id bigint, posting_id string, status string")
    r = K.application_state(ev).first()
    assert r.status == "APPLIED" and r.sent_at == T0 + dt.timedelta(days=1)


def snapshot(path, spark, rows):
    spark.createDataFrame(rows, "board string, external_id string, title string, fetched timestamp, reached boolean").coalesce(1).write.mode("append").parquet(path)


def test_stream_upsert_and_retry(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("src", "store", "ck"))
    schema = ("external_id STRING, title STRING, closed_at TIMESTAMP, first_seen_at TIMESTAMP, fetched_at TIMESTAMP, "
              "form_fetched_at TIMESTAMP, form_readable BOOLEAN")
    snapshot(src, spark, [("a", "1", "x", T0, True), ("a", "2", "x", T0, True), ("b", "7", "x", T0, True)])
    fn = J.upsert_batch(store, schema)
    def run():
        s = spark.readStream.schema("board string, external_id string, title string, fetched timestamp, reached boolean").parquet(src)
        J.run_batches(s, fn, ck)
    run()
    later = T0 + dt.timedelta(days=1)
    snapshot(src, spark, [("a", "1", "y", later, True), ("b", None, None, later, False)])
    run()
    again = spark.createDataFrame([("a", "1", "y", later, True)], "board string, external_id string, title string, fetched timestamp, reached boolean")
    fn(again, 1)
    got = {(r.board, r.external_id): (r.title, r.closed_at is not None) for r in J.current_postings(spark, store, schema).collect()}
    assert got == {("a", "1"): ("y", False), ("a", "2"): ("x", True), ("b", "7"): ("x", False)}


def test_tailoring_keeps_lines_and_order(spark):
    b = spark.createDataFrame([("c", 0, i, t) for i, t in enumerate(["plain", "used kafka", "python and sql", "sql", "also plain", "x"])],
                              "candidate_id string, role_no int, position int, text string")
    a = spark.createDataFrame([("c", "p", ["sql"], ["python", "kafka", "rust"])], "candidate_id string, posting_id string, required_skills array<string>, skills array<string>")
    d = E.tailor_bullets(E.bullet_terms(b, ["python", "sql", "kafka"]), a)
    assert [r.text for r in d.where("kept").orderBy("rank").collect()] == ["python and sql", "sql", "used kafka", "plain"]
    assert E.verbatim_integrity(d.where("kept"), b).count() == 0


def kinds(spark, a, b):
    r = E.verify_rewordings(spark.createDataFrame([(a, b)], "original string, proposal string"), ["python", "spark", "kafka"]).first()
    return sorted({o.kind for o in r.objections})


def test_rewordings(spark):
    assert kinds(spark, "Cut cost by 40%", "Reduced cost by 40%") == []
    assert kinds(spark, "Cut cost by 40%", "Cut cost by 40") == ["dropped-number", "new-number"]
    assert kinds(spark, "Ran two teams", "Managed 2 teams") == ["escalation"]
    assert kinds(spark, "Built it", "  BUILT   it ") == ["unchanged"] and kinds(spark, "Built it", " ") == ["empty"]
    assert kinds(spark, "Built jobs in python", "Built jobs in spark") == ["dropped-technology", "new-technology"]
    assert kinds(spark, "Built jobs", "Built jobs with Initech and") == ["new-entity"]
    assert kinds(spark, "Built a b", "Built a b c d e f g h i j k l") == ["inflated"]


EVENT = "event_id bigint, ts timestamp, candidate_id bigint, posting_id string, status string"


def test_states_and_quiet_notices_over_batches(spark, tmp_path):
    day = lambda n: T0 + dt.timedelta(days=n)
    first = [(1, day(5), 1, "p", "APPLIED"), (2, day(6), 1, "p", "APPLIED"), (3, day(1), 2, "p", "APPLIED"), (4, day(2), 3, "p", "APPLIED"), (5, day(3), 3, "p", "SKIPPED")]
    second = [(6, day(4.9), 1, "p", "APPLIED"), (7, day(8), 2, "p", "SAVED"), (8, day(60), 9, "p", "SAVED")]
    third = [(9, day(61), 2, "p", "APPLIED"), (10, day(90), 9, "p", "SAVED")]
    feed, out, ck, out2, ck2 = (str(tmp_path / n) for n in ("feed", "out", "ck", "out2", "ck2"))
    J.use_rocksdb(spark)
    for rows in (first, second, third):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(EVENT).parquet(feed)
        J.run_updates(J.application_states(stream), out, ck)
        J.run_to_end(J.quiet_applications(stream, 14), out2, ck2)
    got = sorted((r.batch, r.candidate_id, r.status, r.updated_us, r.sent_us) for r in spark.read.parquet(out).collect())
    spark_us = {n: spark.createDataFrame([(day(n),)], "t timestamp").select(F.unix_micros("t")).first()[0] for n in (1, 2, 3, 4.9, 5, 6, 8, 60, 61, 90)}
    want = [(0, 1, "APPLIED", 6, 5), (0, 2, "APPLIED", 1, 1), (0, 3, "SKIPPED", 3, 2), (1, 1, "APPLIED", 6, 5), (1, 2, "SAVED", 8, 1), (1, 9, "SAVED", 60, None),
            (2, 2, "APPLIED", 61, 1), (2, 9, "SAVED", 90, None)]
    assert got == [(b, c, s, spark_us[u], spark_us.get(x)) for b, c, s, u, x in want]
    assert sorted((r.candidate_id, r.updated_us) for r in spark.read.parquet(out2).collect()) == [(1, spark_us[6]), (2, spark_us[61])]
    quiet = J.still_quiet(spark.read.parquet(out2), spark.read.parquet(out))
    assert sorted((r.candidate_id, r.updated_us, r.sent_us) for r in quiet.collect()) == [(1, spark_us[6], spark_us[5]), (2, spark_us[61], spark_us[1])]


def test_a_notice_falls_when_the_application_moves(spark):
    notices = spark.createDataFrame([(1, "p", "APPLIED", 5), (1, "p", "APPLIED", 90), (None, "q", "APPLIED", 7), (2, "p", "APPLIED", 3)], "candidate_id bigint, posting_id string, status string, updated_us bigint")
    states = spark.createDataFrame([(1, "p", "APPLIED", 90, 5), (1, "p", "APPLIED", 5, 5), (None, "q", "APPLIED", 7, 7), (2, "p", "SAVED", 4, 3)],
                                   "candidate_id bigint, posting_id string, status string, updated_us bigint, sent_us bigint")
    assert {tuple(r) for r in J.still_quiet(notices, states).collect()} == {(1, "p", "APPLIED", 90, 5), (None, "q", "APPLIED", 7, 7)}
