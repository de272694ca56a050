"""Listing and form sources: nested vendor JSON in, flat posting and question rows out.

Each reader takes the DataFrame that ``spark.read.schema(schemas.X).json(path)``
gives, plus the board it was landed for as a ``board`` column, and does its work
with one generator and one projection: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia import schemas
from vacantia.functions.text import blank_to_null, col, trim_ws
from vacantia.session import materialise


CORRUPT = "_corrupt"


def read_json(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """Landed JSON with a fixed schema; the board is the landing folder's partition.

    A file holds one document or, with ``one_per_file`` off, one a line.  A document that cannot be read is a row of nulls with its text in ``_corrupt``; ``_file`` is where it came from.
    """
    return (spark.read.schema(f"{schema}, board STRING, {CORRUPT} STRING").option("multiLine", one_per_file).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("_file", F.col("_metadata.file_path")))


def quarantined(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what was read, what was not): the second one keeps board, file and text, and the reason.

    A board of which a document could not be read was not read whole: ``partly`` is set on its other rows, which may be
    added but close nothing.
    """
    landed = materialise(landed)  # the reader wants more than its own column of broken text to be asked for
    bad = landed.where(F.col(CORRUPT).isNotNull()).select("board", F.col("_file").alias("file"), F.col(CORRUPT).alias("text"),
                                                          F.when(F.trim(CORRUPT) == "", "empty").otherwise("not JSON of this kind").alias("reason"))
    boards = bad.select(F.col("board").alias("_b")).distinct().withColumn("partly", F.lit(True))
    good = landed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")
    return good.join(boards, good["board"] == F.col("_b"), "left").drop("_b").withColumn("partly", F.coalesce("partly", F.lit(False))), bad


def _timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _posting(vendor: str, ident: Column, **cols: Column) -> list[Column]:
    vendor_id = ident.cast("string")
    base = {
        "posting_id": F.concat_ws(":", F.lit(vendor), F.col("board"), vendor_id),
        "vendor": F.lit(vendor), "board": F.col("board"), "external_id": vendor_id,
    } | cols
    null = F.lit(None).cast("string")
    kinds = {"posted_at": "timestamp", "first_published": "timestamp",
             "form_publishable": "boolean"}
    return [base.get(n, null).cast(kinds.get(n, "string")).alias(n)
            for n in schemas.POSTING_COLUMNS]


def read_listing_a(df: DataFrame, vendor: str = V.VENDOR_A) -> DataFrame:
    """First vendor: one row per posting with an id and a title; company falls back to board."""
    j = F.col("j")
    return (df.select("board", F.explode("jobs").alias("j"))
            .where(j["id"].isNotNull() & (F.coalesce(j["title"], F.lit("")) != ""))
            .select(*_posting(
                vendor, j["id"],
                title=trim_ws(j["title"]),
                company=F.coalesce(blank_to_null(j["company_name"]), F.col("board")),
                location=blank_to_null(j["location"]["name"]),
                department=blank_to_null(F.try_element_at(j["departments"], F.lit(1))["name"]),
                office=blank_to_null(F.try_element_at(j["offices"], F.lit(1))["name"]),
                url=F.coalesce(j["absolute_url"], F.lit("")),
                posted_at=_timestamp(j["updated_at"]),
                first_published=_timestamp(j["first_published"]),
                html=F.coalesce(j["content"], F.lit("")),
                form_publishable=F.lit(True))))


def read_listing_b(df: DataFrame, vendor: str = V.VENDOR_B) -> DataFrame:
    """Second vendor: unlisted rows drop out; a stated workplace is kept for later."""
    j = F.col("j")
    kind = F.lower(j["workplaceType"])
    return (df.select("board", F.explode("jobs").alias("j"))
            .where((F.coalesce(j["id"], F.lit("")) != "") & (F.coalesce(j["title"], F.lit("")) != "")
                   & F.coalesce(j["isListed"], F.lit(True)))
            .select(*_posting(
                vendor, j["id"],
                title=trim_ws(j["title"]), company=F.col("board"),
                location=blank_to_null(j["location"]),
                department=F.coalesce(blank_to_null(j["department"]), blank_to_null(j["team"])),
                url=F.coalesce(j["jobUrl"], j["applyUrl"], F.lit("")),
                posted_at=_timestamp(j["publishedAt"]),
                first_published=_timestamp(j["publishedAt"]),
                html=F.coalesce(j["descriptionHtml"], j["descriptionPlain"], F.lit("")),
                workplace_stated=F.when(F.coalesce(j["isRemote"], F.lit(False)), "remote")
                .when(kind.isin("hybrid", "onsite"), kind),
                form_publishable=F.lit(False))))


def read_listing_c(df: DataFrame, vendor: str = V.VENDOR_C) -> DataFrame:
    """Third vendor: the root is the list itself; creation time in epoch milliseconds."""
    created = F.when(F.col("createdAt") != 0, F.timestamp_millis("createdAt"))
    return (df.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
            .select(*_posting(
                vendor, F.col("id"),
                title=trim_ws("text"), company=F.col("board"),
                location=blank_to_null(F.col("categories.location")),
                department=blank_to_null(F.col("categories.team")),
                url=F.coalesce("hostedUrl", "applyUrl", F.lit("")),
                posted_at=created, first_published=created,
                html=F.coalesce("description", "descriptionPlain", F.lit("")),
                form_publishable=F.lit(False))))


def union_vendors(*frames: DataFrame) -> DataFrame:
    """All vendors under one posting schema, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flatten_form(df: DataFrame, key: str = "posting_id") -> DataFrame:
    """One row per form question with its fields, kinds and options.

    Forms without questions keep no row here; ``form_summary`` keeps their counts.
    """
    from vacantia.functions.text import classify_question, field_kind, normalise_label

    q = F.col("q")
    fields = F.transform(
        F.coalesce(q["fields"], F.expr("array()").cast(
            "array<struct<name:string,type:string,values:array<struct<label:string,value:string>>>>")),
        lambda f: F.struct(
            F.coalesce(f["name"], F.lit("")).alias("name"),
            field_kind(f["type"]).alias("kind"),
            F.when(F.size(f["values"]) > 0, F.transform(
                F.filter(f["values"], lambda v: v["label"].isNotNull()),
                lambda v: F.struct(v["label"].alias("label"),
                                   F.coalesce(v["value"], F.lit("")).alias("value"))))
            .alias("options")))
    flat = (df.select(key, F.posexplode("questions").alias("position", "q"))
            .select(key, "position", trim_ws(F.coalesce(q["label"], F.lit(""))).alias("label"),
                    F.coalesce(q["required"], F.lit(False)).alias("required"),
                    fields.alias("fields")))
    flat = materialise(flat.withColumn("_kinds", F.transform("fields", lambda f: f["kind"])))
    # The same question stands on very many forms: the patterns run once per wording and kinds.
    once = materialise(flat.select("label", "_kinds").distinct().withColumn("label_key", normalise_label("label"))
                       .withColumn("answerability", classify_question("label_key", "_kinds")))
    return flat.join(once, ["label", "_kinds"]).drop("_kinds")


def form_summary(df: DataFrame, key: str = "posting_id") -> DataFrame:
    """Per form: question count (null when unpublished), demographic count, compliance notes."""
    notes = F.transform(
        F.filter("compliance", lambda c: F.coalesce(c["type"], F.lit("")) != ""),
        lambda c: F.concat(c["type"], F.when(c["requires_consent"], " (consent required)")
                           .otherwise("")))
    return df.select(
        key, F.when(F.col("questions").isNotNull(), F.size("questions")).alias("n_questions"),
        F.coalesce(F.size(F.col("demographic_questions.questions")), F.lit(0)).alias("n_demographic"),
        F.coalesce(notes, F.array().cast("array<string>")).alias("compliance_notes"))


def board_quality(attempts: DataFrame, postings: DataFrame) -> DataFrame:
    """Per vendor: boards attempted and live, postings, postings without a description."""
    a = attempts.groupBy("vendor").agg(
        F.count("*").alias("attempted"), F.count_if(col("reached")).alias("live"))
    p = postings.groupBy("vendor").agg(
        F.count("*").alias("jobs"),
        F.count_if(trim_ws(F.coalesce("html", F.lit(""))) == "").alias("without_description"))
    return a.join(p, "vendor", "left").fillna(0, ["jobs", "without_description"])
