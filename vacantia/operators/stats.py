"""Question statistics, gap reports and counts over plans and applications."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import patterns as P
from vacantia.functions import text as T
from vacantia.operators.sequence import ranked as in_order
from vacantia.session import materialise, spread


# ---------------------------------------------------------------- A1-A4 corpus statistics
def question_stats(questions: DataFrame) -> DataFrame:
    """A1: per (key, class): instances, required instances, distinct postings."""
    return questions.groupBy("label_key", "answerability").agg(
        F.count("*").alias("n"), F.count_if("required").alias("n_required"))


def label_counts(questions: DataFrame) -> DataFrame:
    """Raw questions counted per distinct wording, with the wording's key and class.

    The patterns then run once per wording and not once per question; the sums over
    this table give A1 and A2 (``stats_of_labels``, ``phrasing_of_labels``).
    """
    per = questions.groupBy("label", "kinds").agg(
        F.count("*").alias("n"), F.count_if("required").alias("n_required"))
    return (per.withColumn("label_key", T.normalise_label("label"))
            .withColumn("answerability", T.classify_question("label_key", F.split("kinds", ","))))


def stats_of_labels(labels: DataFrame) -> DataFrame:
    """A1 from ``label_counts``."""
    return labels.groupBy("label_key", "answerability").agg(
        F.sum("n").alias("n"), F.sum("n_required").alias("n_required"))


def phrasing_of_labels(labels: DataFrame) -> DataFrame:
    """A2 from ``label_counts``."""
    per = labels.groupBy("label_key", "label").agg(F.sum("n").alias("c"))
    return per.groupBy("label_key").agg(
        F.min_by("label", F.struct((-F.col("c")).alias("c"), "label")).alias("label"))


def question_reach(questions: DataFrame) -> DataFrame:
    """A1 beside it: distinct postings that ask a key (the other count of Q6)."""
    return (questions.select("label_key", "posting_id").distinct()
            .groupBy("label_key").agg(F.count("*").alias("n_postings")))


def common_phrasing(questions: DataFrame) -> DataFrame:
    """A2: most common label per key, alphabetical among equals; two partial aggregates."""
    per = questions.groupBy("label_key", "label").agg(F.count("*").alias("c"))
    return per.groupBy("label_key").agg(
        F.min_by("label", F.struct((-F.col("c")).alias("c"), "label")).alias("label"))


def required_by_key(stats: DataFrame) -> DataFrame:
    """A3: required instances per key over all its classes."""
    return stats.groupBy("label_key").agg(F.sum("n_required").alias("required_count"))


def route_question(label_key: Column | str, answerability: Column | str) -> Column:
    """A4: yours / skip / perPosting / profile / bank."""
    key, kind = T.col(label_key), T.col(answerability)
    return (F.when(T.human_only(key) | (kind == "demographic"), "yours")
            .when(kind == "file", "skip").when(kind == "generated", "perPosting")
            .when(T.profile_field_for(key).isNotNull(), "profile").otherwise("bank"))


def corpus_gaps(questions: DataFrame) -> DataFrame:
    """The index-wide half of the gap report: routes decided once per key, not per row.

    ``questions`` are rows, or wordings that ``label_counts`` has counted.  They are read once; all else goes over the wordings.
    """
    if "n_required" not in questions.columns:
        questions = questions.groupBy("label_key", "answerability", "label").agg(F.count("*").alias("n"), F.count_if("required").alias("n_required"))
    labels = materialise(questions.select("label_key", "answerability", "label", "n", "n_required"))
    stats = stats_of_labels(labels)
    route = route_question("label_key", "answerability")
    return (stats.withColumn("route", route)
            .withColumn("profile_field", F.when(F.col("route") == "profile",
                                                T.profile_field_for("label_key")))
            .join(required_by_key(labels), "label_key").join(phrasing_of_labels(labels), "label_key"))


# ---------------------------------------------------------------- J6 bank answers for keys
def bank_matches(keys: DataFrame, bank: DataFrame) -> DataFrame:
    """The stored answer for each (candidate, label key): exact before any pattern.

    ``bank(candidate_id, ord, label_keys, label_patterns, …)``.  Both joins are
    equality joins on the candidate; patterns are tried only on keys that no exact
    entry answers, each distinct key once.  Patterns that are refused are left out here.
    """
    bank = screen_patterns(bank)
    wanted = keys.select("candidate_id", "label_key").distinct()
    entry = F.struct("ord", "text", "option_preference", "sensitive")
    b = bank.select("candidate_id", "label_keys", "label_patterns", "ord", entry.alias("e"))
    exact = (wanted.join(b.select("candidate_id", "ord", "e", F.explode("label_keys").alias("label_key")),
                         ["candidate_id", "label_key"])
             .groupBy("candidate_id", "label_key")
             .agg(F.min_by("e", "ord").alias("e")).withColumn("via", F.lit("exact")))
    rest = wanted.join(exact, ["candidate_id", "label_key"], "left_anti")
    tried = (rest.join(b.where(F.size("label_patterns") > 0).select(
        "candidate_id", "ord", "e", F.concat(F.lit("(?:"), F.array_join("label_patterns", ")|(?:"),
                                             F.lit(")")).alias("_p")), "candidate_id")
        .where(F.rlike(F.col("label_key"), F.col("_p")))
        .groupBy("candidate_id", "label_key").agg(F.min_by("e", "ord").alias("e"))
        .withColumn("via", F.lit("pattern")))
    return exact.unionByName(tried).select("candidate_id", "label_key", "via", "e.*")


#: So long that a piece of a number or a name is in few of some million keys.
PIECE = 6


def _pieces(text: str) -> Column:
    """Every piece of at most ``PIECE`` characters, the empty one among them."""
    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in range(1, PIECE + 1)]))


def read_patterns(patterns: DataFrame) -> DataFrame:
    """Distinct patterns ``p`` with ``needs``: per way to match the pieces of text it holds; null where the pattern is refused."""
    @F.pandas_udf("array<array<string>>")
    def needs(ps: pd.Series) -> pd.Series:
        return ps.map(lambda p: P.needs(p, PIECE))

    # Written first: a condition on ``needs`` would else be worked out below ``distinct``, for every row.
    return materialise(patterns.select("p").distinct()).withColumn("needs", needs("p"))


def pattern_candidates(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """(label_key, p): keys that hold a piece of text which pattern ``p`` cannot do without.

    Every way a pattern can match is filed under the piece of it that the fewest keys hold; keys meet patterns
    by equality on a piece.  A way of which some piece is in no key is dropped.  A pattern without any literal
    is filed under the empty piece, that all keys hold.
    """
    ways = materialise(read_patterns(patterns).where("needs is not null").select("p", F.posexplode("needs").alias("way", "pieces")))
    wanted = ways.select("p", "way", F.explode("pieces").alias("piece"))
    blank = F.translate("label_key", P.WHITE, " " * len(P.WHITE))
    held = keys.select("label_key").distinct().withColumn("_k", blank).select("label_key", F.explode(_pieces("_k")).alias("piece"))
    # Merged at every size: the pieces of many patterns are no table for the driver, whatever the plan takes them to be.
    held = held.join(wanted.select("piece").distinct().hint("merge"), "piece", "left_semi")
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    filed = (wanted.join(counts.hint("merge"), "piece", "left").groupBy("p", "way")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest")).where("rarest.n > 0"))
    return spread(filed.select("p", F.col("rarest.piece").alias("piece")).distinct(), "piece", "p").join(held.hint("merge"), "piece").select("label_key", "p").distinct()


def pattern_hits(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """(label_key, p): which accepted patterns match which keys."""
    return pattern_candidates(keys, patterns).where(F.rlike("label_key", F.col("p")))


def pattern_survivors(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per key: patterns tried on it, and those that match."""
    tried = pattern_candidates(keys, patterns).groupBy("label_key").agg(
        F.count("*").alias("tried"), F.count_if(F.rlike("label_key", F.col("p"))).alias("matched"))
    return keys.select("label_key").distinct().join(tried, "label_key", "left").fillna(0, ["tried", "matched"])


def answer_classes(corpus: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label_key, cls), (candidate_id, cls): bankable keys of the corpus that the same entries answer are one class.

    What answers a key is a stored key or a stored pattern.  Keys with the same set of these are answered together or not
    at all, for every candidate, so candidates meet classes and not keys.  A key that nothing answers has no class.
    A set is known by two sums of hashes, so no key's patterns are gathered.
    """
    keys = corpus.where(F.col("route") == "bank").select("label_key").distinct()
    stored = bank.select("candidate_id", F.explode("label_keys").alias("by")).withColumn("exact", F.lit(True))
    wide = bank.select("candidate_id", F.explode("label_patterns").alias("by")).withColumn("exact", F.lit(False))
    by_key = stored.select(F.col("by").alias("label_key")).distinct().join(keys, "label_key").select(
        "label_key", F.lit(True).alias("exact"), F.col("label_key").alias("by"))
    by_pattern = pattern_hits(keys, wide.select(F.col("by").alias("p"))).select("label_key", F.lit(False).alias("exact"), F.col("p").alias("by"))
    answered = materialise(by_key.unionByName(by_pattern))
    sets = answered.groupBy("label_key").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "exact", "by")).alias(f"_h{i}") for i in (0, 1)], F.count("*").alias("_n"))
    ids = materialise(sets.select("_h0", "_h1", "_n").distinct().withColumn("cls", F.monotonically_increasing_id().cast("string")))
    classes = materialise(sets.join(ids, ["_h0", "_h1", "_n"]).select("label_key", "cls"))
    reached = materialise(answered.join(classes, "label_key").select("exact", "by", "cls").distinct())
    return classes, stored.unionByName(wide).join(reached, ["exact", "by"]).select("candidate_id", "cls").distinct()


def corpus_answers(corpus: DataFrame, bank: DataFrame) -> DataFrame:
    """(candidate_id, label_key): bankable keys of the whole corpus a candidate's entries answer.

    A pattern is tried once for all candidates, and only on keys that hold what it cannot do without.
    """
    classes, reached = answer_classes(corpus, bank)
    return reached.join(classes, "cls").select("candidate_id", "label_key")


def screen_patterns(bank: DataFrame) -> DataFrame:
    """Bank entries without the patterns that are refused (see ``functions.patterns``); the others stay as they are.

    Only the distinct patterns visit Python.
    """
    bad = materialise(read_patterns(bank.select(F.explode("label_patterns").alias("p"))).where("needs is null").select("p"))
    hit = (bank.select("candidate_id", "ord", F.explode("label_patterns").alias("p")).join(bad, "p", "left_semi")
           .groupBy("candidate_id", "ord").agg(F.collect_set("p").alias("_bad")))
    return (bank.join(hit, ["candidate_id", "ord"], "left")
            .withColumn("label_patterns", F.filter("label_patterns", lambda p: p.isNotNull() & ~F.coalesce(F.array_contains("_bad", p), F.lit(False)))).drop("_bad"))


# ---------------------------------------------------------------- A5, A6 gap report
def _filled_fields(profiles: DataFrame) -> DataFrame:
    """(candidate_id, profile_field): fields the profile can answer."""
    values = T.profile_values(profiles.columns)
    return (profiles.select("candidate_id", F.explode(values).alias("profile_field", "v"))
            .where(T.blank_to_null("v").isNotNull()).drop("v"))


def _per_class(corpus: DataFrame, answers: DataFrame, classes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(label_key, cls), (candidate_id, cls); without classes each key is one."""
    if classes is not None:
        return classes, answers
    keys = corpus.where(F.col("route") == "bank").select("label_key").distinct()
    return keys.withColumn("cls", F.col("label_key")), answers.select("candidate_id", F.col("label_key").alias("cls"))


def gap_reach(corpus: DataFrame, profiles: DataFrame, answers: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Question instances one more answer would resolve, per candidate and kind.

    Worked out as total minus answered, so no (candidate, key) product is built.
    ``answers`` is the J6 result for these candidates, or with ``classes`` the one of ``answer_classes``.
    """
    classes, answers = _per_class(corpus, answers, classes)
    per_field = corpus.where(F.col("route") == "profile").groupBy("profile_field").agg(
        F.sum("n").alias("n"))
    all_profile = per_field.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    bankable = corpus.where(F.col("route") == "bank").groupBy("label_key").agg(F.sum("n").alias("n"))
    all_bank = bankable.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    by_profile = (_filled_fields(profiles).join(materialise(per_field), "profile_field")
                  .groupBy("candidate_id").agg(F.sum("n").alias("p")))
    per_class = materialise(bankable.join(classes, "label_key").groupBy("cls").agg(F.sum("n").alias("n")))
    by_bank = answers.join(per_class, "cls").groupBy("candidate_id").agg(F.sum("n").alias("b"))
    return (profiles.select("candidate_id").join(by_profile, "candidate_id", "left")
            .join(by_bank, "candidate_id", "left")
            .select("candidate_id",
                    (all_profile - F.coalesce("p", F.lit(0))).cast("bigint").alias("profile_reach"),
                    (all_bank - F.coalesce("b", F.lit(0))).cast("bigint").alias("bankable_reach")))


KINDS = {"yours": "yours", "perPosting": "perPosting", "profile": "profile", "bank": "bankable"}


def gap_report_corpus(corpus: DataFrame) -> DataFrame:
    """A5 in full, the part that all candidates share: every row a report can show, in the order of n_instances.

    With ``gap_report_answered`` and ``gap_report_totals`` it is the whole report, without candidates x keys:
    a candidate's rows are these, less the profile rows of the fields answered there, with the bank answers there last.
    """
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return corpus.where(F.col("route") != "skip").select(
        names[F.col("route")].alias("kind"), "label_key", "answerability", "label", F.col("n").alias("n_instances"),
        "required_count", "profile_field")


def gap_report_answered(corpus: DataFrame, profiles: DataFrame, bank: DataFrame) -> DataFrame:
    """A5 in full, per candidate: bankable keys of the corpus with the stored answer, and the profile fields that are filled."""
    stored = bank_matches(corpus_answers(corpus, bank), bank).select(
        "candidate_id", F.lit("bankable").alias("kind"), "label_key", F.lit(None).cast("string").alias("profile_field"), F.col("text").alias("answer"))
    asked = corpus.where(F.col("route") == "profile").select("profile_field").distinct()
    filled = _filled_fields(profiles).join(asked, "profile_field").select(
        "candidate_id", F.lit("profile").alias("kind"), F.lit(None).cast("string").alias("label_key"), "profile_field", F.lit(None).cast("string").alias("answer"))
    return stored.unionByName(filled)


def gap_report_totals(corpus: DataFrame, profiles: DataFrame, answers: DataFrame, postings: DataFrame,
                      classes: DataFrame | None = None) -> DataFrame:
    """Forms read, questions in them, and the reach of what is open, per candidate."""
    forms = postings.agg(F.count_if(F.col("form_fetched_at").isNotNull() & F.col("form_readable"))).scalar()
    total = corpus.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return gap_reach(corpus, profiles, answers, classes).select(
        "candidate_id", forms.cast("bigint").alias("forms_read"), total.cast("bigint").alias("total_questions"), "profile_reach", "bankable_reach")


def gap_report(corpus: DataFrame, profiles: DataFrame, answers: DataFrame,
               limit: int, classes: DataFrame | None = None) -> DataFrame:
    """A5, as displayed: the first ``limit`` open gaps per candidate and kind, most instances first.

    Keys are answered by classes (see ``answer_classes``; a profile field is one, and so is all that nothing answers), of which
    the first ``limit`` keys are enough.  A candidate with ``a`` answered classes finds its first open ones among the first
    ``limit + a``.  Each distinct set of answered classes is looked up once, by an equality join on the ranks, and then joined
    to its candidates.  A limit of the number of keys gives the full list.
    """
    classes, answers = _per_class(corpus, answers, classes)
    order = [F.col("n").desc(), F.col("label_key"), F.col("answerability")]
    cls = F.when(F.col("route") == "bank", F.col("cls")).when(F.col("route") == "profile", F.col("profile_field"))
    per_key = (corpus.where(F.col("route") != "skip").join(classes, "label_key", "left")
               .withColumn("cls", F.coalesce(F.concat(F.lit("="), cls), F.lit(""))))
    own = Window.partitionBy("route", "cls").orderBy(*order)
    menu = materialise(per_key.withColumn("_i", F.row_number().over(own)).where(F.col("_i") <= limit))
    # Ranked over classes: question types, not rows of the index.
    heads = materialise(in_order(menu.where("_i = 1").select("route", "cls", "n", "label_key", "answerability"), "route", order, "pos").select("route", "cls", "pos"))

    filled = _filled_fields(profiles).select("candidate_id", F.lit("profile").alias("route"), F.concat(F.lit("="), "profile_field").alias("cls"))
    closed = answers.select("candidate_id", F.lit("bank").alias("route"), F.concat(F.lit("="), "cls").alias("cls")).unionByName(filled)
    closed = closed.join(heads.select("route", "cls"), ["route", "cls"]).groupBy("candidate_id", "route").agg(F.array_sort(F.collect_set("cls")).alias("closed"))
    # Rows of one candidate_id share its places, each gap once a row.
    who = (profiles.groupBy("candidate_id").agg(F.count("*").alias("_m"))
           .withColumn("route", F.explode(F.array(*[F.lit(r) for r in KINDS])))
           .join(closed, ["candidate_id", "route"], "left").withColumn("closed", F.coalesce("closed", F.array().cast("array<string>"))))
    who = materialise(who)
    asks = (who.select("route", "closed").distinct()
            .withColumn("pos", F.explode(F.sequence(F.lit(1), F.size("closed") + F.lit(limit)))))
    # (route, pos) names one class, so this join has no hot key.
    found = asks.join(heads, ["route", "pos"]).where(~F.array_contains("closed", F.col("cls")))
    per_set = Window.partitionBy("route", "closed")
    found = found.withColumn("_c", F.row_number().over(per_set.orderBy("pos"))).where(F.col("_c") <= limit).drop("pos", "_c")
    rows = materialise(found.join(menu.drop("_i"), ["route", "cls"]).withColumn("_r", F.row_number().over(per_set.orderBy(*order)))
                       .where(F.col("_r") <= limit).select("route", "closed", "_r", "label_key", "label", "n", "required_count", "profile_field"))
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return (who.join(rows, ["route", "closed"]).where((F.col("_r") - 1) * F.col("_m") < limit)
            .withColumn("gap_rank", F.explode(F.sequence((F.col("_r") - 1) * F.col("_m") + 1, F.least(F.col("_r") * F.col("_m"), F.lit(limit)))))
            .select("candidate_id", names[F.col("route")].alias("kind"), F.col("gap_rank").cast("int").alias("gap_rank"), "label_key",
                    "label", F.col("n").alias("n_instances"), "required_count", "profile_field"))


def answered_gaps(corpus: DataFrame, answers: DataFrame) -> DataFrame:
    """A5, the answered bankable rows: what is stored now and how far it reaches."""
    bank = corpus.where(F.col("route") == "bank").select(
        "label_key", "label", F.col("n").alias("n_instances"), "required_count")
    return answers.select("candidate_id", "label_key", F.col("text").alias("answer")).join(
        bank, "label_key")


def answer_unlocks(questions: DataFrame) -> DataFrame:
    """Stored questions one answer resolves, per key."""
    return questions.groupBy("label_key").agg(F.count("*").alias("unlocks"))


def group_paraphrases(gaps: DataFrame) -> DataFrame:
    """Keys that differ only by "this role", "the job" … merged, follow-ups left out.

    ``gaps(label_key, label, n)``.  The shown label is the one of the largest key.
    """
    stem = T.squeeze(F.regexp_replace("label_key", V.PARAPHRASE_NOUN, ""))
    return (gaps.where(~F.col("label_key").rlike(V.FOLLOW_UP_QUESTION))
            .withColumn("stem", stem).groupBy("stem").agg(
                F.min_by("label", F.struct((-F.col("n")).alias("n"), "label_key")).alias("label"),
                F.sum("n").alias("n"), F.count("*").alias("n_keys")))


def reuse_curve(questions: DataFrame) -> DataFrame:
    """Instances, distinct keys, reuse ratio, fewest keys that cover half the instances.

    Keys are counted by how often they occur; the running sum then goes over the
    distinct frequencies, of which there are at most about sqrt(2 x instances).
    """
    freq = (questions.groupBy("label_key").agg(F.count("*").alias("n"))
            .groupBy("n").agg(F.count("*").alias("keys")))
    total = F.lit(freq.agg(F.sum(F.col("n") * F.col("keys"))).scalar())
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = freq.select("n", "keys", F.sum(F.col("n") * F.col("keys")).over(w).alias("covered"),
                      F.sum("keys").over(w).alias("used")).withColumn("total", total)
    before = F.col("covered") - F.col("n") * F.col("keys")
    inside = F.ceil((F.col("total") / 2 - before) / F.col("n"))
    reached = (F.col("covered") * 2 >= F.col("total")) & (before * 2 < F.col("total"))
    half = F.min(F.when(reached, F.col("used") - F.col("keys") + inside))
    return run.agg(F.max("total").cast("bigint").alias("instances"),
                   F.sum("keys").cast("bigint").alias("unique_keys"),
                   half.cast("bigint").alias("keys_for_half")).withColumn(
        "reuse", F.round(F.try_divide("instances", "unique_keys"), 4))


# ---------------------------------------------------------------- A10-A15
STATUSES = ("SAVED", "READY", "APPLIED", "SKIPPED")


def status_counts(applications: DataFrame) -> DataFrame:
    """A10: applications per status, one row per candidate."""
    return applications.groupBy("candidate_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def plan_counts(actions: DataFrame, form_sizes: DataFrame,
                keys: Sequence[str] = ("candidate_id", "posting_id")) -> DataFrame:
    """Per form, actions by source and what is left over.

    ``form_sizes(posting_id, form_fields)`` counts the questions of the form.
    """
    src = F.col("source")
    per = actions.groupBy(*keys).agg(
        F.count("*").alias("planned"),
        F.count_if(src.isin("profile", "bank", "file")).alias("deterministic"),
        *[F.count_if(src == s).alias("n_" + s)
          for s in ("profile", "bank", "file", "generated", "user", "unresolved")],
        F.count_if((src == "unresolved") & F.col("required")).alias("blocking"))
    return (per.join(form_sizes, "posting_id")
            .withColumn("skipped_optional", F.greatest(F.col("form_fields") - F.col("planned"), F.lit(0)))
            .withColumn("executable", (F.col("blocking") == 0) & (F.col("n_generated") == 0)))


def plan_summary(per_form: DataFrame) -> DataFrame:
    """The corpus of plans in one row, from the per-form counts."""
    done = (F.col("n_generated") == 0) & (F.col("n_user") == 0) & (F.col("blocking") == 0)
    return per_form.agg(
        F.count("*").alias("plans"), F.sum("planned").alias("actions"),
        *[F.sum("n_" + s).alias("n_" + s)
          for s in ("profile", "bank", "file", "generated", "user", "unresolved")],
        F.count_if(done).alias("fully_deterministic"),
        F.count_if(F.col("blocking") > 0).alias("blocked_forms"),
        F.count_if(F.col("n_user") > 0).alias("needs_user_forms"),
        F.count_if(F.col("n_generated") > 0).alias("needs_writing_forms"))


def kit_coverage(stated: Column | str, fields: Column | str) -> Column:
    """Stated questions as a share of the form; null when the form's size is unknown."""
    s, f = T.col(stated), T.col(fields)
    return F.when(f > 0, F.round(s / f * 100).cast("int"))


def weighted_mean_score(categories: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the judged categories by weight; 0 when none could be judged."""
    judged = F.col("weight") > 0
    mean = F.try_divide(F.sum(F.when(judged, F.col("score") * F.col("weight"))),
                        F.sum(F.when(judged, F.col("weight"))))
    return categories.groupBy(*keys).agg(
        F.coalesce(F.round(mean).cast("int"), F.lit(0)).alias("score"))


def skill_demand(postings: DataFrame) -> DataFrame:
    """Per term, postings that name it and postings that require it."""
    named = postings.select(F.explode("skills").alias("term"), F.lit(0).alias("req"))
    required = postings.select(F.explode("required_skills").alias("term"), F.lit(1).alias("req"))
    return named.unionByName(required).groupBy("term").agg(
        F.count_if(F.col("req") == 0).alias("asked"), F.count_if(F.col("req") == 1).alias("required"))
