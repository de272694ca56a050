"""Form questions to actions: option matching, the decision ladder, kits and worklists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T
from vacantia.operators.stats import bank_matches, kit_coverage
from vacantia.session import materialise


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# ---------------------------------------------------------------- J7 match_option
def match_option(preferences: Column | str, options: Column | str) -> Column:
    """``struct<label, value, via>`` of the best option, or null.

    Every strategy (exact, canonical, synonym, substring) is tried for the first
    preference before the second.  Works inside the row: no shuffle.
    """
    def with_class(o: Column) -> Column:
        return T.let(T.canon_option(o["label"]), lambda c: F.struct(
            o["label"].alias("label"), o["value"].alias("value"), c.alias("canon"),
            T.synonym_class(c).alias("cls")))

    def via(p: Column, o: Column) -> Column:
        return (F.when(o["label"] == p["raw"], 1).when(o["canon"] == p["canon"], 2)
                .when(o["cls"] == p["cls"], 3)
                .when((F.length(p["canon"]) >= 4) & (F.contains(o["canon"], p["canon"])
                                                     | F.contains(p["canon"], o["canon"])), 4))

    def search(opts: Column) -> Column:
        prefs = F.transform(T.col(preferences), lambda p: T.let(T.canon_option(p), lambda c: F.struct(
            p.alias("raw"), c.alias("canon"), T.synonym_class(c).alias("cls"))))
        # Per preference the option with the lowest (strategy, position).
        best = F.transform(F.filter(prefs, lambda p: p["canon"] != ""), lambda p: F.array_min(F.filter(
            F.transform(opts, lambda o, i: F.struct(via(p, o).alias("via"), i.alias("i"),
                                                    o["label"].alias("label"), o["value"].alias("value"))),
            lambda m: m["via"].isNotNull())))
        return F.try_element_at(F.filter(best, lambda m: m.isNotNull()), F.lit(1))

    found = T.let(F.transform(T.col(options), with_class), search)
    names = F.array(*[F.lit(x) for x in ("exact", "canonical", "synonym", "substring")])
    return T.let(found, lambda m: F.when(m.isNotNull(), F.struct(
        m["label"].alias("label"), m["value"].alias("value"),
        F.element_at(names, m["via"]).alias("via"))))


# ---------------------------------------------------------------- T11 + T12 once per label
def label_questions(questions: DataFrame) -> DataFrame:
    """``label_key`` and ``answerability``, worked out once per distinct (label, field kinds).

    The same question stands on very many forms, so the patterns run on the distinct
    labels and the result is written and joined back: its size is known, so that a small one is broadcast
    and the questions are not shuffled by their (few, hot) labels.
    """
    d = questions.withColumn("_kinds", F.array_join(F.transform("fields", lambda f: f["kind"]), ","))
    once = materialise(d.select("label", "_kinds").distinct().withColumn("label_key", T.normalise_label("label"))
                       .withColumn("answerability", T.classify_question("label_key", F.split("_kinds", ","))))
    return d.join(once, ["label", "_kinds"]).drop("_kinds")


def key_facts(questions: DataFrame) -> DataFrame:
    """Per distinct (label key, class): who must answer, which profile field, letter, follow-up."""
    k = questions.select("label_key", "answerability").distinct()
    return (k.withColumn("_people", F.when(F.col("answerability") == "demographic", "demographic")
                         .when(T.forbids_generated("label_key"), "no generated answer")
                         .when(F.col("label_key").rlike(T.any_of(V.HEALTH_PATTERNS)), "health")
                         .when(F.col("label_key").rlike(T.any_of(V.CONSENT_PATTERNS)), "consent"))
            .withColumn("_want", T.profile_field_for("label_key"))
            .withColumn("_follow_up", F.col("label_key").rlike(V.FOLLOW_UP_QUESTION)))


# ---------------------------------------------------------------- P2 attachment pairs
def resolve_attachment_pair(fields: Column | str, label_key: Column | str,
                            ladder_first: Column) -> Column:
    """The fields that get an action: of a file + text pair only one half.

    A cover letter keeps the text, any other attachment the file.  ``ladder_first``
    is true where an earlier rule already decides the question for all its fields.
    """
    f = T.col(fields)
    files = F.filter(f, lambda x: x["kind"] == "file")
    texts = F.filter(f, lambda x: x["kind"].isin("long_text", "short_text"))
    pair = (F.size(files) > 0) & (F.size(texts) > 0) & ~ladder_first
    chosen = F.when(T.col(label_key).contains("cover letter"), texts).otherwise(files)
    return F.when(pair, F.slice(chosen, 1, 1)).otherwise(f)


# ---------------------------------------------------------------- P1 compile_plan
def compile_plan(questions: DataFrame, profiles: DataFrame, bank: DataFrame) -> DataFrame:
    """One row per form field: what fills it (``source``), with which value, and why.

    ``questions``: candidate_id, posting_id, position, label, label_key, required,
    answerability, fields.  ``profiles``: candidate_id, ``resume_name`` and the
    profile fields.  Everything the ladder reads is joined first; the ladder is one
    ordered condition, so nothing shuffles after the joins.
    """
    # Questions go through their one shuffle as numbers: of the wording with its fields, and of the key.
    wording = ("label", "label_key", "answerability", "fields")
    words = questions.select(*wording).distinct().where("label_key is not null and answerability is not null")
    words = materialise(words.join(key_facts(words), ["label_key", "answerability"]).withColumn("_w", F.monotonically_increasing_id()))
    ids = materialise(words.groupBy("label_key").agg(F.min("_w").alias("_k"), F.first("_want").alias("_want")))
    words = materialise(words.join(ids.select("label_key", "_k"), "label_key"))  # written, so that its size is known
    named = words.select(F.col("_w"), F.col("_k"), *[F.col(c).alias(f"_{c}") for c in wording])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in wording]
    q = questions.join(named, reduce(lambda x, y: x & y, same)).select("candidate_id", "posting_id", "position", "required", "_w", "_k")

    # What a candidate's profile and stored answers say to a key, worked out once per candidate and key.
    p = profiles.select("candidate_id", "resume_name",
                        T.profile_values(profiles.columns).alias("_values"))
    answers = bank_matches(questions, bank).join(ids.select("label_key", "_k"), "label_key").select(
        "candidate_id", "_k", F.col("via").alias("_via"), F.col("text").alias("_text"),
        F.col("option_preference").alias("_prefs"), F.col("sensitive").alias("_sensitive"))
    told = (q.select("candidate_id", "_k").distinct().join(p, "candidate_id", "left").join(ids.select("_k", "_want"), "_k")
            .select("candidate_id", "_k", "resume_name", T.blank_to_null(F.try_element_at("_values", F.col("_want"))).alias("_value"))
            .join(answers, ["candidate_id", "_k"], "left"))
    a = q.join(told, ["candidate_id", "_k"], "left").join(words.drop("_k"), "_w").drop("_w", "_k")
    kept = resolve_attachment_pair("fields", "label_key", F.col("_people").isNotNull())
    a = a.select(*[c for c in a.columns if c != "fields"],
                 (F.size(kept) < F.size("fields")).alias("_pair"),
                 F.posexplode(kept).alias("field_no", "_f")).select(
        "*", F.col("_f.name").alias("field_name"), F.col("_f.kind").alias("kind"),
        F.col("_f.options").alias("options")).drop("_f")
    prefs = F.coalesce("_prefs", F.when(F.coalesce("_text", F.lit("")) != "", F.array("_text")))
    key, kind = F.col("label_key"), F.col("kind")
    letter = key.contains("cover letter")
    select = kind.isin("single_select", "multi_select")
    # One option match per field: the profile's value if there is one, else the stored answer.
    wanted = F.when(select & F.col("_people").isNull(),
                    F.coalesce(F.when(F.col("_value").isNotNull(), F.array("_value")), prefs))
    a = a.withColumn("_option", F.when(wanted.isNotNull(), match_option(wanted, "options")))
    n_options = F.coalesce(F.size("options"), F.lit(0))
    has_bank = F.col("_via").isNotNull()
    sensitive = F.coalesce("_sensitive", F.lit(False))
    bank_text = F.coalesce("_text", F.try_element_at("_prefs", F.lit(1)))

    def act(source: str, value: Column | None = None, option: Column | None = None,
            reason: str | Column | None = None) -> Column:
        return F.struct(F.lit(source).alias("source"),
                        (value if value is not None else _null()).alias("value"),
                        (option if option is not None else _null()).alias("option_value"),
                        (F.lit(reason).cast("string") if not isinstance(reason, Column) else reason)
                        .alias("reason"))

    attach = F.when(F.col("resume_name").isNotNull(), act("file", F.col("resume_name"))) \
        .otherwise(act("unresolved", reason="no document on file"))
    no_choices = F.when(n_options == 0, "choices unknown").otherwise("no option matches")
    profile_select = F.when(
        F.col("_option").isNull(), act("user", F.col("_value"), reason=no_choices)
    ).otherwise(act("profile", F.col("_option.label"), F.col("_option.value")))
    bank_select = F.when(
        F.col("_option").isNull(), act("user", reason=no_choices)
    ).when(sensitive & (F.col("_option.via") == "substring"),
           act("user", F.col("_option.label"), reason="uncertain option")
           ).otherwise(act("bank", F.col("_option.label"), F.col("_option.value")))

    # Fields without an action: hidden ones, and optional profile fields left blank.  Tested
    # apart from the ladder, so that the filter does not work the whole ladder out as well.
    attachment = F.col("_pair") | (kind == "file") | (F.col("answerability") == "file")
    inert = (kind == "unknown") & F.col("field_name").rlike(V.INERT_FIELD) & ~F.col("_pair")
    left_blank = (~attachment & F.col("_value").isNull() & ~F.col("required")
                  & F.col("_want").isNotNull())
    a = a.where(F.col("_people").isNotNull() | ~(inert | left_blank))
    action = (
        F.when(F.col("_people").isNotNull(), act("user", reason=F.col("_people")))
        .when((F.col("_pair") | (kind == "file")) & letter, act("generated", reason="letter"))
        .when(attachment, attach)
        .when(F.col("_value").isNotNull(),
              F.when(select, profile_select).otherwise(act("profile", F.col("_value"))))
        .when(has_bank & sensitive & (F.col("_via") == "pattern"),
              act("user", reason="legal question in other words"))
        .when(has_bank & select, bank_select)
        .when(has_bank & (F.coalesce(bank_text, F.lit("")) != ""), act("bank", bank_text))
        .when(F.col("answerability") == "generated", act("generated", reason="writing"))
        .when(F.col("_follow_up"), act("user", reason="follow-up"))
        .otherwise(act("unresolved", reason=F.when(
            F.col("answerability") == "bank", "no saved answer").otherwise("not on the profile"))))
    return (a.withColumn("_a", action)
            .select("candidate_id", "posting_id", "position", "field_no", "label", "label_key",
                    "required", "answerability", "field_name", "kind",
                    F.col("_a.source").alias("source"), F.col("_a.value").alias("value"),
                    F.col("_a.option_value").alias("option_value"),
                    F.col("_a.reason").alias("reason"),
                    F.when((F.col("_a.source") == "unresolved") & (n_options > 0),
                           F.transform("options", lambda o: o["label"])).alias("choices")))


def executable(actions: DataFrame) -> DataFrame:
    """Forms with no required gap and nothing left to write."""
    return actions.groupBy("candidate_id", "posting_id").agg(
        F.count_if((F.col("source") == "unresolved") & F.col("required")).alias("blocking"),
        F.count_if(F.col("source") == "generated").alias("to_write")).withColumn(
        "executable", (F.col("blocking") == 0) & (F.col("to_write") == 0))


# ---------------------------------------------------------------- P4-P9
def form_state(fetched_at: Column | str = "form_fetched_at",
               readable: Column | str = "form_readable") -> Column:
    """Unread / readable / unpublished."""
    return (F.when(T.col(fetched_at).isNull(), "unread")
            .when(F.coalesce(T.col(readable), F.lit(False)), "readable").otherwise("unpublished"))


def bucket(source: Column | str, has_attachment: Column) -> Column:
    """P5: answers / yours / open; a file nobody can attach is open."""
    s = T.col(source)
    return (F.when(s == "file", F.when(has_attachment, "answers").otherwise("open"))
            .when(s.isin("profile", "bank"), "answers").when(s == "user", "yours")
            .otherwise("open"))


def run_row(postings: DataFrame, actions: DataFrame, form_sizes: DataFrame,
            attachments: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Counts per (candidate, posting) row, or the reason why there are none.

    A posting that is not among ``indexed`` (posting_id), where given, has no form to plan for any more.

    ``postings``: candidate_id, posting_id and form columns; ``form_fetched_at``
    may be null.  ``attachments(candidate_id)`` holds candidates with a document.
    """
    has = attachments.select("candidate_id").distinct().withColumn("_has", F.lit(True))
    b = bucket("source", F.coalesce("_has", F.lit(False)))
    counts = (actions.join(has, "candidate_id", "left").withColumn("_b", b)
              .groupBy("candidate_id", "posting_id")
              .agg(*[F.count_if(F.col("_b") == n).alias(c) for n, c in
                     (("answers", "prepared"), ("yours", "yours"), ("open", "open"))]))
    state = form_state()
    reason = (F.when(state == "unread", "form not read yet")
              .when(state == "unpublished", "no readable form"))
    if indexed is not None:
        there = indexed.select("posting_id").distinct().withColumn("_there", F.lit(True))
        postings_in = postings.join(there, "posting_id", "left")
        reason = reason.when(F.col("_there").isNull(), "no longer indexed")
    else:
        postings_in = postings
    out = (postings_in.join(counts, ["candidate_id", "posting_id"], "left")
           .join(form_sizes, "posting_id", "left").withColumn("reason", reason))
    ok = F.col("reason").isNull()
    return out.select(
        *postings.columns, "reason",
        *[F.when(ok, F.coalesce(c, F.lit(0))).alias(c) for c in ("prepared", "yours", "open")],
        F.when(ok, F.coalesce("form_fields", F.lit(0))).alias("fields"))


def expected_questions(unread: DataFrame, bank: DataFrame, attachments: DataFrame) -> DataFrame:
    """For forms nobody could read, the recurring questions the candidate can answer."""
    value = F.coalesce("text", F.try_element_at("option_preference", F.lit(1)))
    key = F.try_element_at("label_keys", F.lit(1))
    rows = (bank.select("candidate_id", "ord", F.coalesce("note", T.label_from_key(key)).alias("label"),
                        value.alias("value"), key.alias("label_key"))
            .where((F.coalesce("value", F.lit("")) != "") & F.col("label_key").isNotNull())
            .select("candidate_id", "ord", "label", F.lit("bank").alias("source"), "value"))
    files = attachments.select(
        "candidate_id", F.lit(2**31 - 1).alias("ord"), F.lit("Resume/CV").alias("label"),
        F.lit("file").alias("source"), _null().alias("value")).distinct()
    return (unread.select("candidate_id", "posting_id").join(rows.unionByName(files), "candidate_id")
            .withColumn("read", F.lit(False)))


def answer_once(actions: DataFrame, companies: DataFrame) -> DataFrame:
    """Open questions one saved answer closes, and whether they name the employer."""
    return (actions.where((F.col("source") == "unresolved") & (F.col("answerability") == "bank"))
            .join(companies.select("posting_id", "company"), "posting_id")
            .withColumn("employer", F.when(T.names_employer("label", "company"), F.col("company"))))


def guard_bank(answers: DataFrame) -> DataFrame:
    """``accepted`` is false for questions only the person may answer."""
    return answers.withColumn("accepted", ~T.human_only("label_key"))


# ---------------------------------------------------------------- J8 page fields
def _norm_page(c: Column | str) -> Column:
    c = F.regexp_replace(F.replace(F.lower(T.col(c)), F.lit("*"), F.lit("")),
                         r"\(optional\)|\(required\)", "")
    return T.squeeze(F.regexp_replace(c, r"[^\w\s/-]", ""))


def match_plan_to_page(actions: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions onto page fields by name, then id, then label; each field filled once.

    ``actions``: form_id, ord, field_name, label, source, value, required.
    ``fields``: form_id, ord, handle, name, id, label, kind, options.
    Returns (actions with ``outcome`` fill / skipped / unmatched, unplanned fields).
    """
    def layer(col: Column, name: str) -> DataFrame:
        # Of two fields under one key the later one counts; options are read of a select only.
        options = F.when(F.col("kind") == "select", F.col("options")).alias("options")
        return (fields.where(col.isNotNull() & (col != ""))
                .groupBy(F.col("form_id").alias("_form"), col.alias("_" + name))
                .agg(F.max_by(F.struct("handle", "kind", options), "ord").alias("_f_" + name)))

    def met(a: DataFrame, mine: Column, col: Column, name: str) -> DataFrame:
        return a.join(layer(col, name), (F.col("form_id") == F.col("_form")) & (mine == F.col("_" + name)), "left").drop("_form", "_" + name)

    a = actions.select("form_id", "ord", "field_name", "label", "source", "value")
    a = met(met(a, F.col("field_name"), F.col("name"), "name"), F.col("field_name"), F.col("id"), "id")
    a = a.select("form_id", "ord", "label", "source", "value", F.coalesce("_f_name", "_f_id").alias("_field"),
                 F.when(F.col("_f_name").isNotNull(), "name").when(F.col("_f_id").isNotNull(), "id").alias("via"))
    # Only what has no field yet is looked up by its label.
    a = a.withColumn("_label", F.when(F.col("_field").isNull(), _norm_page("label")))
    a = met(a, F.col("_label"), F.when(F.coalesce("label", F.lit("")) != "", _norm_page("label")), "lab").drop("_label")
    a = (a.withColumn("_field", F.coalesce("_field", "_f_lab"))
         .withColumn("via", F.coalesce("via", F.when(F.col("_f_lab").isNotNull(), "label"))))
    skip = (F.when(F.col("source") == "user", "the candidate answers this")
            .when(F.col("source") == "generated", "needs writing")
            .when(F.col("source") == "unresolved", "nothing stored")
            .when(F.coalesce("value", F.lit("")) == "", "no value"))
    chosen = F.try_element_at(F.filter(F.col("_field.options"),
                                       lambda o: _norm_page(o) == _norm_page("value")), F.lit(1))
    is_select = F.col("_field.kind") == "select"
    a = (a.withColumn("_skip", skip).withColumn("_opt", F.when(is_select, chosen))
         .withColumn("_can", F.col("_skip").isNull() & F.col("_field").isNotNull()
                     & (~is_select | F.col("_opt").isNotNull()))
         .withColumn("handle", F.col("_field.handle")).withColumn("_none", F.col("_field").isNull()))
    a = a.select("form_id", "ord", "label", "value", "via", "handle", "_skip", "_opt", "_can", "_none")
    first = F.min(F.when(F.col("_can"), F.col("ord"))).over(Window.partitionBy("form_id", "handle"))
    a = a.withColumn("_first", F.when(F.col("form_id").isNotNull() & F.col("handle").isNotNull(), first))
    outcome = (F.when(F.col("_skip").isNotNull(), "skipped")
               .when(F.col("_none") | (F.col("_first") < F.col("ord")), "unmatched")
               .when(F.col("_can"), "fill").otherwise("skipped"))
    a = a.withColumn("outcome", outcome)
    filled = F.col("outcome") == "fill"
    matched = a.select(
        "form_id", "ord", "label", "outcome", F.when(filled, F.col("handle")).alias("handle"),
        F.when(filled, F.coalesce("_opt", "value")).alias("value"),
        F.when(filled, F.col("via")).alias("via"),
        F.when(F.col("outcome") == "skipped", F.coalesce("_skip", F.lit("option not offered")))
        .alias("reason"))
    used = matched.where(F.col("outcome") == "fill").select("form_id", "handle")
    planned = actions.select("form_id", _norm_page("label").alias("_l")).distinct()
    f = fields.where(F.col("kind") != "unknown").withColumn("_l", F.when(
        F.coalesce("label", F.lit("")) != "", _norm_page("label")))
    unplanned = (f.join(used, ["form_id", "handle"], "left_anti")
                 .join(planned, ["form_id", "_l"], "left_anti")
                 .select("form_id", "handle", F.coalesce("label", "name", F.lit("(unlabelled)"))
                         .alias("label"), "kind"))
    return matched, unplanned


# ---------------------------------------------------------------- J4, W10 worklist
def worklist(ranked: DataFrame, applications: DataFrame, k: int) -> DataFrame:
    """W10, first half (with J4): best ``k`` postings not yet applied to or skipped.

    ``ranked`` has candidate_id, posting_id, rank.  ``available`` counts what is left.
    """
    done = applications.where(F.col("status").isin("APPLIED", "SKIPPED")).select(
        "candidate_id", "posting_id")
    left = ranked.join(done, ["candidate_id", "posting_id"], "left_anti")
    available = left.groupBy("candidate_id").agg(F.count("*").alias("available"))
    w = Window.partitionBy("candidate_id").orderBy("rank", "posting_id")
    return (left.withColumn("run_no", F.row_number().over(w)).where(F.col("run_no") <= k)
            .join(available, "candidate_id"))


def worklist_totals(rows: DataFrame) -> DataFrame:
    """W10, second half: totals per candidate and how many rows could not be prepared."""
    return rows.groupBy("candidate_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("prepared", "yours", "open")],
        F.count_if(F.col("reason").isNotNull()).alias("could_not_prepare"),
        F.max("available").alias("available"))


# ---------------------------------------------------------------- P11 kit
def kit_counts(actions: DataFrame, attachments: DataFrame, form_sizes: DataFrame,
               keys: Sequence[str] = ("candidate_id", "posting_id")) -> DataFrame:
    """P11's numbers: prepared / yours / open, coverage of the form, skipped blanks."""
    has = attachments.select("candidate_id").distinct().withColumn("_has", F.lit(True))
    b = bucket("source", F.coalesce("_has", F.lit(False)))
    return _with_coverage(actions.join(has, "candidate_id", "left").groupBy(*keys).agg(*_bucket_counts(b)), form_sizes)


def _bucket_counts(b: Column) -> list[Column]:
    return [*[F.count_if(b == n).alias(c) for n, c in (("answers", "prepared"), ("yours", "yours"), ("open", "open"))],
            F.count("*").alias("stated")]


def _with_coverage(per: DataFrame, form_sizes: DataFrame) -> DataFrame:
    return (per.join(form_sizes, "posting_id", "left")
            .withColumn("coverage", kit_coverage("stated", "form_fields"))
            .withColumn("skipped_optional_blank", F.when(
                F.col("form_fields").isNotNull(),
                F.greatest(F.col("form_fields") - F.col("stated"), F.lit(0)))))


def kit(actions: DataFrame, attachments: DataFrame, form_sizes: DataFrame) -> DataFrame:
    """One nested row per (candidate, posting) with its three ordered question lists.

    The lists have as many entries as the form has fields.
    """
    docs = attachments.groupBy("candidate_id").agg(F.collect_list(F.struct("resume_name")).alias("_docs"))
    rows = actions.where("candidate_id IS NOT NULL AND posting_id IS NOT NULL").join(docs, "candidate_id", "left")
    none = F.array(F.struct(_null().alias("resume_name")))

    def entry(d: Column) -> Column:
        doc, source = d["resume_name"], F.col("source")
        missing = (source == "file") & doc.isNull()
        return F.struct(bucket("source", doc.isNotNull()).alias("b"), F.struct(
            "position", "field_no", "label", "field_name", "required",
            F.when(missing, "unresolved").otherwise(source).alias("source"),
            F.when(source == "file", doc).otherwise(F.col("value")).alias("value"),
            F.when(missing, "no document on file").otherwise(F.col("reason")).alias("reason")).alias("row"))

    # One row a form: its entries and its numbers come from one grouping.
    per = rows.groupBy("candidate_id", "posting_id").agg(
        F.flatten(F.collect_list(F.transform(F.coalesce("_docs", none), entry))).alias("_all"),
        *_bucket_counts(bucket("source", F.col("_docs").isNotNull())))

    def entries(b: str) -> Column:
        return F.array_sort(F.transform(F.filter("_all", lambda x: x["b"] == b), lambda x: x["row"]))

    lists = [entries(b).alias(c) for b, c in (("answers", "answers"), ("yours", "your_answers"), ("open", "open_items"))]
    out = _with_coverage(per.select("candidate_id", "posting_id", *lists, "prepared", "yours", "open", "stated"), form_sizes)
    return out.select("candidate_id", *[c for c in out.columns if c != "candidate_id"])
