"""Streams against their batch twins, with turns out of order, arrivals again and batches worked off twice."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vacantia.operators import requests as R
from vacantia.streaming import jobs as J
from test_search import POSTING, POSTINGS, SKILLS, filt, now, searches


def test_alerts_are_sent_once(spark, tmp_path):
    s = searches(spark, [("w", None, filt(words=["data"])), ("c", None, filt(company="Beta")), ("all", None, filt())])
    ledger, feed = str(tmp_path / "ledger"), str(tmp_path / "feed")
    apply = J.alerts_batch(ledger, lambda _: s, now())
    first, second = POSTINGS[:4], POSTINGS[2:]  # two of the postings arrive again
    for rows in (first, second, second):
        spark.createDataFrame(rows, POSTING).write.mode("append").parquet(feed)
        J.run_batches(spark.readStream.schema(POSTING).parquet(feed), apply, str(tmp_path / "ck"))
    sent = sorted((r.search_id, r.posting_id, r.batch) for r in J.sent_alerts(spark, ledger, "string").collect())
    assert len({x[:2] for x in sent}) == len(sent)
    want = {(r.search_id, r.posting_id) for rows in (first, second) for r in J.search_alerts(spark.createDataFrame(rows, POSTING), s, now()).collect()}
    assert {x[:2] for x in sent} == want
    apply(spark.createDataFrame(second, POSTING), 1)  # a batch again
    apply(spark.createDataFrame(first, POSTING), 0)
    assert sorted((r.search_id, r.posting_id, r.batch) for r in J.sent_alerts(spark, ledger, "string").collect()) == sent


def test_conversations_in_any_order_of_arrival(spark, tmp_path):
    J.use_rocksdb(spark)
    r = random.Random(1)
    say = ["senior data engineer in london", "only this week", "with python", "and sql, python", "product manager", "data analyst jobs in india", "start over", "hybrid"]
    t0 = dt.datetime(2026, 1, 1)
    rows = [(c, t, f"{c}-{t}", r.choice(say), t0 + dt.timedelta(minutes=t)) for c in range(12) for t in range(9)]
    close = [(99, 0, "99-0", "hybrid", t0 + dt.timedelta(days=1))]  # moves the watermark behind all others
    shuffled = r.sample(rows, len(rows))
    schema = "conv_id bigint, turn bigint, msg_id string, text string, ts timestamp"
    feed = str(tmp_path / "feed")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (shuffled[:40], shuffled[40:], close):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        J.run_to_end(J.conversation_stream(R.parse_requests(stream, None, SKILLS), "2 hours"), out, ck)
    got = {(x.conv_id, x.turn): x for x in spark.read.parquet(out).collect()}
    batch = R.fold_conversation(R.parse_requests(spark.createDataFrame(rows, schema), None, SKILLS)).collect()
    assert len(got) == len(batch) == len(rows)
    for x in batch:
        y = got[x.conv_id, x.turn]
        assert (y.words or [], y.skills or [], y.level, y.days, y.place, y.workplace, y.reset) == (
            x.f.words, x.f.skills, x.f.level, x.f.days, x.f.place and x.f.place.label, x.f.workplace, x.reset), (x, y)
