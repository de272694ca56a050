"""Index maintenance: facts, upserts, closing what vanished, form state, reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T

FACT_COLUMNS = ("skills", "required_skills", "requirements_found", "level", "workplace",
                "years_required", "remote", "remote_scope", "country", "description",
                "description_chars")
FACTS_VERSION = 1


# ---------------------------------------------------------------- T10 extract_facts
def extract_facts(postings: DataFrame, vocab: Iterable[str],
                  gazetteer: Iterable[tuple[str, str]] = V.GAZETTEER,
                  version: int = FACTS_VERSION) -> DataFrame:
    """All text facts of a posting in one pass over ``title``, ``location`` and ``html``.

    The cleaned text is a column of its own so that it is computed once per row.
    Level reads the title only; required skills read the requirements section
    only, with no fallback; null means the posting does not say.
    """
    vocab = list(vocab)
    stated = F.col("workplace_stated") if "workplace_stated" in postings.columns else F.lit(None)
    return (
        postings
        .withColumn("_text", T.html_to_text(F.coalesce("html", F.lit(""))))
        .withColumn("_req", T.requirements_section("_text"))
        .withColumn("_search", F.concat_ws("\n", "title", "_text"))
        .withColumn("skills", T.terms_in("_search", vocab))
        .withColumn("required_skills", T.terms_in(F.col("_req.section"), vocab))
        .withColumn("requirements_found", F.col("_req.found"))
        .withColumn("level", T.level_of("title"))
        .withColumn("workplace", F.coalesce(stated.cast("string"),
                                            T.workplace_of("title", "_search")))
        .withColumn("years_required", F.coalesce(T.required_years(F.col("_req.section")),
                                                 T.required_years("_text")))
        .withColumn("remote", F.coalesce(F.col("workplace") == "remote", F.lit(False)))
        .withColumn("remote_scope", F.when(F.col("location").isNotNull(),
                                           T.remote_scope_of("location", "_text")))
        .withColumn("country", T.country_of("location", gazetteer))
        .withColumn("description", F.substring("_text", 1, V.SUMMARY_CHARS))
        .withColumn("description_chars", F.length("_text"))
        .withColumn("facts_version", F.lit(version))
        .drop("_text", "_req", "_search"))


def backfill_facts(postings: DataFrame, vocab: Iterable[str], version: int = FACTS_VERSION, **kw) -> DataFrame:
    """Facts for the rows an older version left behind; a second run finds none."""
    stale = postings.where(F.coalesce("facts_version", F.lit(0)) < version)
    return extract_facts(stale, vocab, version=version, **kw)


# ---------------------------------------------------------------- S7-S9 upsert
def upsert_postings(target: DataFrame, snapshot: DataFrame, now: Column,
                    keys: Sequence[str] = ("board", "external_id")) -> DataFrame:
    """Target after a snapshot: facts replaced, reopened, first seen kept, form state kept.

    One full outer join on the key.  Restrict ``target`` to the boards the
    snapshot touches before calling; other boards never change.
    """
    kept = {"first_seen_at", "form_fetched_at", "form_readable", "closed_at", "fetched_at"}
    t = target.select(*keys, F.lit(True).alias("_old"),
                      *[F.col(c).alias("_t_" + c) for c in target.columns if c not in keys])
    s = snapshot.select(*keys, F.lit(True).alias("_new"),
                        *[F.col(c).alias("_s_" + c) for c in snapshot.columns if c not in keys])
    j = t.join(s, list(keys), "full_outer")
    listed, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def old(c: str) -> Column:
        return F.col("_t_" + c)

    def new(c: str) -> Column:
        return F.col("_s_" + c) if c in snapshot.columns else F.lit(None)

    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "closed_at":
            out.append(F.when(~listed, old(c)).alias(c))
        elif c == "first_seen_at":
            out.append(F.when(known, old(c)).otherwise(now).alias(c))
        elif c == "fetched_at":
            out.append(F.when(listed, now).otherwise(old(c)).alias(c))
        elif c in ("form_fetched_at", "form_readable"):
            # Only a form that was read in this pass changes the state.
            read = new("form_fetched_at").isNotNull()
            out.append(F.when(read, new(c)).otherwise(old(c)).alias(c))
        elif c in snapshot.columns and c not in kept:
            out.append(F.when(listed, new(c)).otherwise(old(c)).alias(c))
        else:
            out.append(old(c).alias(c))
    return j.select(*out)


def closable_boards(snapshot: DataFrame, board_status: DataFrame) -> DataFrame:
    """Boards that were reached and listed at least one posting."""
    return (board_status.where("reached").select("board").distinct()
            .join(snapshot.select("board"), "board", "left_semi"))


def close_delisted(target: DataFrame, snapshot: DataFrame, board_status: DataFrame,
                   now: Column) -> DataFrame:
    """``closed_at`` set on open postings of closable boards that are no longer listed."""
    boards = closable_boards(snapshot, board_status).withColumn("_closable", F.lit(True))
    listed = (snapshot.select("board", "external_id").distinct()
              .withColumn("_listed", F.lit(True)))
    j = target.join(boards, "board", "left").join(listed, ["board", "external_id"], "left")
    gone = F.col("_closable").isNotNull() & F.col("_listed").isNull() & F.col("closed_at").isNull()
    return j.withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at"))) \
            .select(*target.columns)


def replace_children(children: DataFrame, new_children: DataFrame,
                     key: str = "posting_id") -> DataFrame:
    """Every child row of a touched parent is replaced by the new ones."""
    touched = new_children.select(key).distinct()
    return children.join(touched, key, "left_anti").unionByName(new_children)


# ---------------------------------------------------------------- S10-S12 forms
def form_state_from_fetch(fetches: DataFrame, now: Column) -> DataFrame:
    """What a fetch may write; an unreached form writes nothing (no row)."""
    return (fetches.where("reached")
            .withColumn("form_readable", F.col("questions").isNotNull())
            .withColumn("form_fetched_at", now))


def backfill_queue(postings: DataFrame, limit: int, board: str | None = None) -> DataFrame:
    """Open postings never asked for their form, newest first, top ``limit``."""
    q = postings.where(F.col("form_fetched_at").isNull() & F.col("closed_at").isNull())
    if board is not None:
        q = q.where(F.col("board") == board)
    return q.orderBy(F.col("posted_at").desc_nulls_last(), "posting_id").limit(limit)


def backfill_report(outcomes: DataFrame, postings: DataFrame, key: str = "posting_id") -> DataFrame:
    """Counts of form fetches by outcome, the questions they brought, and the open postings still to ask.

    ``postings`` are as before the pass; an unreached form stays to be asked.
    """
    asked = outcomes.where("reached").select(key).distinct()
    waiting = postings.where(F.col("form_fetched_at").isNull() & F.col("closed_at").isNull())
    remaining = waiting.join(asked, key, "left_anti").agg(F.count("*")).scalar()
    reached, published = F.col("reached"), F.col("questions").isNotNull()
    return outcomes.agg(
        F.count("*").alias("attempted"),
        F.count_if(reached & published).alias("readable"),
        F.count_if(reached & ~published).alias("unpublished"),
        F.count_if(~reached).alias("unreachable"),
        F.coalesce(F.sum(F.when(reached & published, F.size("questions"))), F.lit(0))
        .cast("bigint").alias("questions_written")).withColumn("remaining", remaining)


# ---------------------------------------------------------------- S14-S18 reports, repairs
def refresh_report(board_status: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: boards, failed boards, postings seen, closed by this pass, forms read."""
    seen = board_status.agg(
        F.count("*").alias("boards"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("reached"), F.col("board")))), ",")
        .alias("failed"),
        F.coalesce(F.sum("n_listed"), F.lit(0)).cast("bigint").alias("jobs_seen"))

    def count(df: DataFrame, cond: Column) -> Column:
        return df.agg(F.count_if(cond)).scalar()

    closed, read = F.col("closed_at").isNotNull(), F.col("form_fetched_at").isNotNull()
    return seen.select(
        "*", (count(after, closed) - count(before, closed)).alias("jobs_closed"),
        (count(after, read) - count(before, read)).alias("forms_read"))


def index_is_stale(boards: DataFrame, hours: float, now: Column) -> DataFrame:
    """No board read for ``hours``; all never read is stale, no boards is not."""
    newest = F.max("last_fetched_at").cast("timestamp")
    gap = F.unix_millis(now.cast("timestamp")) - F.unix_millis(newest)
    return boards.where(~F.col("disabled")).agg(
        F.when(F.count("*") == 0, False).when(newest.isNull(), True)
        .otherwise(gap > hours * 3_600_000).alias("stale"))


def index_health(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """Totals and the oldest and newest board read, in one row."""
    on = boards.where(~F.col("disabled"))
    return postings.agg(
        F.count("*").alias("total"), F.count_if(F.col("closed_at").isNull()).alias("open"),
    ).select("*", on.agg(F.min("last_fetched_at")).scalar().alias("oldest_read"),
             on.agg(F.max("last_fetched_at")).scalar().alias("newest_read"))


def dedupe_array_keep_order(c: Column | str) -> Column:
    """Array without repeats, first occurrence kept."""
    return F.array_distinct(T.col(c))


def clamp_future_timestamps(df: DataFrame, column: str, now: Column) -> DataFrame:
    """Timestamps after ``now`` are brought back to it; nulls stay null."""
    c = F.col(column)
    return df.withColumn(column, F.when(c > now, now).otherwise(c))
