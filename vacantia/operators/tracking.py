"""Applications, sent records, follow-ups, profiles, export and erasure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T


# ---------------------------------------------------------------- J3, X3 batch twin
def application_view(applications: DataFrame, postings: DataFrame, sent: DataFrame) -> DataFrame:
    """Applications with their posting and, where there is one, the sent record."""
    p = postings.select("posting_id", "title", "company", "location")
    s = sent.select("candidate_id", "posting_id", "sent_at")
    return applications.join(p, "posting_id").join(s, ["candidate_id", "posting_id"], "left")


def application_state(events: DataFrame) -> DataFrame:
    """X3's batch twin: latest status per (candidate, posting); sent at the first APPLIED only.

    Ordered by event time, ties by event id, so late and repeated events end alike.
    """
    at = F.struct("ts", "event_id")
    return events.groupBy("candidate_id", "posting_id").agg(
        F.max_by("status", at).alias("status"), F.max("ts").alias("updated_at"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "APPLIED", F.col("ts"))).alias("sent_at"))


# ---------------------------------------------------------------- W17-W19, S24
def follow_ups(applications: DataFrame, now: Column, days: int = V.FOLLOW_UP_DAYS,
               sent_col: str = "sent_at") -> DataFrame:
    """W17 (W19 with ``sent_col="updated_at"``): applied, nothing moved for ``days``."""
    quiet = F.col(sent_col) < now - F.expr(f"interval {int(days)} days")
    return (applications.where((F.col("status") == "APPLIED") & quiet)
            .withColumn("days_quiet", T.days_old(sent_col, now)))


def follow_up_due(applications: DataFrame, now: Column, after: int = 7) -> DataFrame:
    """Applied and not updated for ``after`` whole days or more."""
    days = T.days_old("updated_at", now)
    return (applications.where((F.col("status") == "APPLIED") & (days >= after))
            .withColumn("days", days))


def quiet_flag(now: Column, days: int = V.FOLLOW_UP_DAYS) -> Column:
    """Applied, sent, and older than the window."""
    return ((F.col("status") == "APPLIED")
            & F.coalesce(F.col("sent_at") < now - F.expr(f"interval {int(days)} days"), F.lit(False)))


def retention_sweep(sent: DataFrame, now: Column, months: int = V.RETENTION_MONTHS) -> DataFrame:
    """Sent records with the end of their keeping time; ``expired`` when it is past."""
    return (sent.withColumn("expires_at", F.col("sent_at") + F.expr(f"interval {int(months)} months"))
            .withColumn("expired", F.col("expires_at") <= now))


# ---------------------------------------------------------------- S19-S21 export, erasure
def erase_candidates(tables: Mapping[str, DataFrame], ids: DataFrame,
                     key: str = "candidate_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given candidates."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def export_candidates(profiles: DataFrame, applications: DataFrame, answers: DataFrame,
                      searches: DataFrame, variants: DataFrame, files: DataFrame) -> DataFrame:
    """One nested document per candidate, every list in a stated order.

    Write it with ``df.write.partitionBy(...).json(path)``.
    """
    def nest(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
        return df.groupBy("candidate_id").agg(
            F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    out = profiles.select("candidate_id", F.struct(
        *[c for c in profiles.columns if c != "candidate_id"]).alias("profile"))
    for df, name, cols in (
        (files, "resumes", ("uploaded_at", "filename", "bytes", "sha256", "active")),
        (applications, "applications", ("created_at", "posting_id", "status", "updated_at", "sent_at")),
        (answers, "saved_answers", ("ord", "label_keys", "text")),
        (searches, "saved_searches", ("created_at", "label", "f")),
        (variants, "variants", ("name", "current_title", "skills", "active")),
    ):
        out = out.join(nest(df, name, cols), "candidate_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


# ---------------------------------------------------------------- S26, S27, J9, J12
def select_variant(variants: DataFrame, events: DataFrame) -> DataFrame:
    """One active variant per candidate, or none: the last select event decides.

    An event with a null name clears; one that names no variant is refused.
    """
    known = variants.select("candidate_id", "name").distinct().withColumn("_known", F.lit(True))
    valid = (events.join(known, ["candidate_id", "name"], "left")
             .where(F.col("name").isNull() | F.col("_known")))
    chosen = valid.groupBy("candidate_id").agg(
        F.max_by(F.struct("name"), F.struct("ts", "event_id")).alias("_c"))
    return (variants.join(chosen, "candidate_id", "left")
            .withColumn("active", F.when(F.col("_c").isNull(), F.col("active")).otherwise(
                F.coalesce(F.col("name") == F.col("_c.name"), F.lit(False)))).drop("_c"))


_TEXT_FIELDS = ("phone", "location", "city", "country", "postal_code", "linkedin", "github",
                "website", "current_title")


def normalise_profile(df: DataFrame) -> DataFrame:
    """Trimmed or null texts, lower-case skills, and what is wrong in ``errors``."""
    for c in _TEXT_FIELDS:
        if c in df.columns:
            df = df.withColumn(c, T.blank_to_null(c))
    for c in ("first_name", "last_name", "email"):
        df = df.withColumn(c, T.trim_ws(F.coalesce(c, F.lit(""))))
    df = df.withColumn("skills", F.transform("skills", lambda s: F.lower(T.trim_ws(s))))
    roles = F.coalesce(F.size("experience"), F.lit(0)) if "experience" in df.columns else F.lit(0)
    crowded = (F.exists("experience", lambda r: F.size(r["bullets"]) > V.MAX_BULLETS)
               if "experience" in df.columns else F.lit(False))
    checks = (("first_name", F.col("first_name") == ""), ("last_name", F.col("last_name") == ""),
              ("email", ~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")),
              ("skills: too many", F.size("skills") > V.MAX_SKILLS),
              ("skills: blank", F.exists("skills", lambda s: s == "")),
              ("experience: too many", roles > V.MAX_ROLES), ("bullets: too many", crowded))
    return df.withColumn("errors", F.filter(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda e: e.isNotNull()))


def refuse_unknown_fields(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Unknown columns are an error, not ignored."""
    extra = [c for c in df.columns if c not in known]
    if extra:
        raise ValueError(f"unknown profile fields: {', '.join(extra)}")
    return df


def current_company(experience: Column | str) -> Column:
    """Employer of the one role without an end; null when none or several."""
    ongoing = F.filter(T.col(experience), lambda r: T.blank_to_null(r["end"]).isNull())
    return F.when(F.size(ongoing) == 1, F.element_at(ongoing, 1)["company"])


def effective_profile(profiles: DataFrame, variants: DataFrame, files: DataFrame) -> DataFrame:
    """Profile with the active variant's title and skills and the document in use."""
    v = variants.where("active").select("candidate_id", F.col("current_title").alias("_vt"),
                                        F.col("skills").alias("_vs"))
    f = (files.where("active").groupBy("candidate_id")
         .agg(F.max_by("filename", F.struct("uploaded_at", "filename")).alias("resume_name")))
    return (profiles.join(v, "candidate_id", "left").join(f, "candidate_id", "left")
            .withColumn("current_title", F.coalesce("_vt", "current_title"))
            .withColumn("skills", F.when(F.size("_vs") > 0, F.col("_vs")).otherwise(F.col("skills")))
            .drop("_vt", "_vs"))


# ---------------------------------------------------------------- J1, J2, J11
def with_board(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """Posting with its enabled board; Spark broadcasts the boards when they are small."""
    return postings.join(boards.where(~F.col("disabled")).drop("disabled"), "board")


def with_question_count(postings: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions per posting: null when the form was never read, 0 when it had none."""
    n = questions.groupBy("posting_id").agg(F.count("*").alias("_n"))
    return (postings.join(n, "posting_id", "left")
            .withColumn("question_count", F.when(F.col("form_fetched_at").isNotNull(),
                                                 F.coalesce("_n", F.lit(0)))).drop("_n"))


def fetch_in_order(ranked_ids: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows of an id list; order them by the list's ``rank``."""
    return ranked_ids.join(postings, "posting_id").orderBy("rank")


def requests_over_limit(events: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """X7's rule on a batch: keys with more than ``limit`` events in a calendar minute."""
    return (events.groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count("*").alias("n"))
            .where(F.col("n") > limit).select(F.col("w.start").alias("minute"), key, "n"))
