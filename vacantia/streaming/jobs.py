"""Structured Streaming jobs: upserts, first seen, lifecycles, alerts, limits, conversations.

Sources and sinks are the caller's; every job takes a streaming DataFrame and
gives one back, or a ``foreachBatch`` function.  Event times have to be of type
timestamp (cast a timestamp without zone under a UTC session first).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vacantia import fixed_values as V
from vacantia.operators import index as X
from vacantia.operators import search as S

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_rocksdb(spark: SparkSession) -> None:
    """State outside the heap, with changelogs in the shared checkpoint folder."""
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)


# ---------------------------------------------------------------- X1 stream_upsert
def current_postings(spark: SparkSession, store: str, schema: str,
                     before: int | None = None) -> DataFrame:
    """The store's rows, per board those of its latest batch (or the latest before one).

    A batch writes only the boards it touches, under ``batch=…/board=…``; the latest
    batch per board is read from the folder names, so older files are never opened.
    """
    try:
        every = spark.read.schema(schema + ", batch BIGINT, board STRING").parquet(store)
    except Exception as e:  # the first batch finds no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", batch BIGINT, board STRING")
    if before is not None:
        every = every.where(F.col("batch") < before)
    latest = every.groupBy("board").agg(F.max("batch").alias("batch"))
    return every.join(latest, ["board", "batch"])


def upsert_batch(store: str, schema: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies board snapshots to a store.

    A snapshot row carries ``fetched`` (time of the read) and ``reached``; a board
    that was not reached changes nothing.  Only touched boards are read, joined and
    written.  Writing a batch again replaces its own folder, so a retry is harmless.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snap = batch.where("reached")
        rows = snap.where(F.col("external_id").isNotNull())
        # Several reads of one board in a batch: the latest one counts.
        last = snap.groupBy("board").agg(F.max("fetched").alias("fetched"))
        rows = rows.join(last, ["board", "fetched"])
        # A retried batch must start from the state before its own first try.
        before = current_postings(spark, store, schema, batch_id).drop("batch")
        touched = before.join(last.select("board"), "board", "left_semi")
        now = F.current_timestamp()
        names = [c for c in rows.columns if c not in ("fetched", "reached")]
        after = X.upsert_postings(touched, rows.select(*names), now)
        boards = last.select("board", F.lit(True).alias("reached"))
        after = X.close_delisted(after, rows, boards, now)
        (after.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "board").parquet(store))
    return apply


# ---------------------------------------------------------------- X2 first_seen
def first_seen(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first arrival per key; repeats inside the bound are dropped."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- X3 + X4 lifecycle
_APPLICATION = ("candidate_id", "posting_id")


def _latest() -> Column:
    return F.max(F.struct("ts", "event_id", "status")).alias("last")


def application_states(events: DataFrame) -> DataFrame:
    """Status per (candidate, posting) and the sent record, for output mode update.

    A batch gives the rows of the applications it touched.  A sent record is the earliest APPLIED of the batch that
    first had one: the batch's own time comes first in what is compared, so a later batch never changes it.
    State is one row per application; a row however late counts, as it does in the batch twin.
    """
    applied = F.when(F.col("status") == "APPLIED", F.struct("_batch", F.col("ts").alias("at")))
    out = events.withColumn("_batch", F.current_timestamp()).groupBy(*_APPLICATION).agg(_latest(), F.min(applied).alias("sent"))
    return out.select(*_APPLICATION, "last.status", F.unix_micros("last.ts").alias("updated_us"), F.unix_micros("sent.at").alias("sent_us"))


def quiet_applications(events: DataFrame, quiet_days: int = V.FOLLOW_UP_DAYS, lateness: str = "1 hour") -> DataFrame:
    """A notice per APPLIED application without an event for ``quiet_days``, for output mode append.

    Events that lie closer are one session; it ends when the watermark (of milliseconds) has passed the quiet days after
    its last event, and its state goes with it.  A notice holds the last status and its time.  An application that moves after
    such a pause has a notice of the pause all the same; ``still_quiet`` tells which of them stand.
    """
    e = events.withColumn("_ms", F.date_trunc("millisecond", "ts")).withWatermark("_ms", lateness)
    last = e.groupBy(F.session_window("_ms", f"{quiet_days} days"), *_APPLICATION).agg(_latest())
    return last.where(F.col("last.status") == "APPLIED").select(*_APPLICATION, "last.status", F.unix_micros("last.ts").alias("updated_us"))


def still_quiet(notices: DataFrame, states: DataFrame) -> DataFrame:
    """Of the notices those whose application has not moved since, with its sent record, from X3's rows of all batches."""
    now = states.groupBy(*_APPLICATION).agg(F.max(F.struct("updated_us", "status", "sent_us")).alias("_now"))
    same = F.col("updated_us").eqNullSafe(F.col("_now.updated_us"))
    for k in _APPLICATION:
        now = now.withColumnRenamed(k, f"_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return notices.join(now, same).select(*_APPLICATION, "status", "updated_us", F.col("_now.sent_us").alias("sent_us"))


# ---------------------------------------------------------------- X5 search_alerts
def search_alerts(new_postings: DataFrame, searches: DataFrame, now: Column,
                  rules: DataFrame | None = None, places=V.REQUEST_PLACES) -> DataFrame:
    """For a batch of new postings the searches they match.

    The same operator as the saved-search counts, driven by the delta, so the work
    grows with the arrivals and not with the index.
    """
    return S.search(new_postings, searches, now, rules, places)


LEDGER = "search_id {id}, posting_id STRING"
LEDGER_PARTS = 64


def _part_of(posting_id: str = "posting_id") -> Column:
    return F.pmod(F.xxhash64(posting_id), F.lit(LEDGER_PARTS)).cast("int")


def sent_alerts(spark: SparkSession, ledger: str, id_type: str = "BIGINT", before: int | None = None) -> DataFrame:
    """The ledger: search_id, posting_id, batch, part; with ``before``, only what earlier batches sent."""
    schema = LEDGER.format(id=id_type) + ", batch BIGINT, part INT"
    try:
        sent = spark.read.schema(schema).parquet(ledger)
    except Exception as e:  # nothing was sent yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return sent if before is None else sent.where(F.col("batch") < before)


def alerts_batch(ledger: str, searches: Callable[[SparkSession], DataFrame], now: Column,
                 rules: DataFrame | None = None, places=V.REQUEST_PLACES) -> Callable[[DataFrame, int], None]:
    """X5 as a stream: a ``foreachBatch`` function that sends each (search, posting) alert once.

    A batch of arrivals meets the searches as they are then, and what the ledger has already is left out: a posting that
    arrives again gives no second alert.  The ledger is written per batch, so working a batch off again
    replaces what its first try wrote; it is read without that, and so gives the same alerts.  Only the parts of the
    ledger that the arrivals fall into are read.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = searches(spark)
        # with its part in the keys a pair is dealt once, for being told apart and for being looked up
        hits = search_alerts(batch, asked, now, rules, places).select(_part_of().alias("part"), "search_id", "posting_id").distinct()
        sent = sent_alerts(spark, ledger, asked.schema["search_id"].dataType.simpleString(), batch_id)
        arrived = batch.select(_part_of().alias("part")).distinct()  # at most LEDGER_PARTS rows
        sent = sent.join(arrived, "part", "left_semi").drop("batch")
        (hits.join(sent, ["part", "search_id", "posting_id"], "left_anti").withColumn("batch", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(ledger))
    return apply


# ---------------------------------------------------------------- X6 conversations
class Conversation(StatefulProcessor):
    """The filters of a conversation, turn by turn, in the order of turns and not of arrival.

    A turn waits in map state until the watermark has passed its time; then all that wait up to that
    time are folded in order.  State of a conversation that rests for ``rest_ms`` goes, and the
    conversation would start afresh.
    """

    SLOTS = ("words", "place", "workplace", "level", "company", "days")
    SAID = (*SLOTS, "skills")

    def __init__(self, rest_ms: int) -> None:
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn BIGINT", "ms BIGINT, fresh BOOLEAN, said STRING")
        self.state = handle.getValueState("filters", "said STRING, until_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for part in rows:
            for r in part.itertuples(index=False):
                self.waiting.updateValue((int(r.turn),), (int(r.ms), bool(r.fresh), r.said))
                if (r.ms,) not in known and r.ms not in known:
                    self.handle.registerTimer(int(r.ms))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        had = self.state.exists()
        said, until = self.state.get() if had else (None, 0)
        if had and until <= now:  # nothing came for the whole rest
            self.state.clear()
            had = False
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= now)
        slots = json.loads(said) if had else {}
        out = []
        for turn, (_, fresh, parts) in due:
            self.waiting.removeKey((turn,))
            if fresh or not had:
                slots = {}
            new = json.loads(parts)
            skills = slots.get("skills", [])
            slots = {**slots, **{k: v for k, v in new.items() if k != "skills"}, "skills": skills + [x for x in new.get("skills", []) if x not in skills]}
            out.append((key[0], turn, json.dumps(slots), bool(fresh and had)))
            had = True
        if due:
            until = now + self.rest_ms
            self.state.update((json.dumps(slots), until))
            self.handle.registerTimer(until)
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "turn", "said", "reset"]).astype({"conv_id": "int64", "turn": "int64", "reset": "bool"})

    def close(self) -> None:
        pass


SAID = "words ARRAY<STRING>, place STRING, workplace STRING, level STRING, company STRING, days INT, skills ARRAY<STRING>"


def conversation_stream(parsed: DataFrame, lateness: str = "10 minutes", rest: str = "30 days") -> DataFrame:
    """The stream twin of ``fold_conversation`` over parsed requests with the time ``ts`` of each turn.

    A turn comes out when the watermark has passed its time, after all turns before it, whatever order they arrived in.
    """
    named = sum(F.col(c).isNotNull().cast("int")
                for c in ("place", "workplace", "level", "company", "days", "skills"))
    fresh = F.col("asks_reset") | (~F.col("refining") & F.col("words").isNotNull() & (named > 0))
    said = F.to_json(F.struct("words", F.col("place.label").alias("place"), "workplace", "level", "company", "days", "skills"))
    flat = parsed.withWatermark("ts", lateness).select("conv_id", "turn", "ts", F.unix_millis("ts").alias("ms"), F.coalesce(fresh, F.lit(False)).alias("fresh"), said.alias("said"))
    rest_ms = int(pd.Timedelta(rest).total_seconds() * 1000)
    out = flat.groupBy("conv_id").transformWithStateInPandas(Conversation(rest_ms), "conv_id BIGINT, turn BIGINT, said STRING, reset BOOLEAN", "Append", "EventTime")
    return out.select("conv_id", "turn", F.from_json("said", SAID).alias("f"), "reset").select("conv_id", "turn", "f.*", "reset")


# ---------------------------------------------------------------- X7 limits
def requests_over_limit(stream: DataFrame, limit: int, key: str = "user_id",
                        lateness: str = "1 minute") -> DataFrame:
    """Keys with more than ``limit`` events in a calendar minute, once the minute is over."""
    counts = (stream.withWatermark("ts", lateness)
              .groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count("*").alias("n")))
    return counts.where(F.col("n") > limit).select(F.col("w.start").alias("minute"), key, "n")


# ---------------------------------------------------------------- running a job to its end
def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Work off what the source holds and stop; results go to parquet in ``out``."""
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """As ``run_to_end`` for output mode update: each batch's rows in a folder ``batch=…``, which a retry replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
