"""Evidence lines: tailoring, resume scoring, letter facts, rewording checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T
from vacantia.operators.stats import weighted_mean_score
from vacantia.session import materialise


def _strings() -> Column:
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- W11-W14 tailoring
def bullet_terms(bullets: DataFrame, vocab: Iterable[str]) -> DataFrame:
    """Terms each bullet evidences, from the vocabulary postings are read with."""
    return bullets.withColumn("terms", T.terms_in("text", list(vocab)))


def tailor_bullets(bullets: DataFrame, asks: DataFrame, per_role: int | None = 4,
                   min_per_role: int = 2) -> DataFrame:
    """Rank each role's bullets for a posting and mark the kept ones.

    ``bullets``: candidate_id, role_no, position, text, terms.
    ``asks``: candidate_id, posting_id, required_skills, skills.
    ``per_role=None`` keeps all (W14).  Roles keep their own order.
    """
    d = bullets.join(asks, "candidate_id")
    required = F.coalesce("required_skills", _strings())
    asked = F.array_union(required, F.coalesce("skills", _strings()))
    matched = F.array_intersect("terms", asked)
    d = (d.withColumn("matched", matched)
         .withColumn("score", F.size("matched") + F.size(F.array_intersect("matched", required)))
         .drop("required_skills", "skills"))
    w = Window.partitionBy("candidate_id", "posting_id", "role_no").orderBy(
        F.col("score").desc(), "position")
    d = d.withColumn("rank", F.row_number().over(w))
    if per_role is None:
        return d.withColumn("kept", F.lit(True))
    return d.withColumn("kept", F.col("rank") <= max(per_role, min_per_role))


def base_resume(bullets: DataFrame) -> DataFrame:
    """Every bullet kept in its own order, no posting involved."""
    asks = bullets.select("candidate_id").distinct().select(
        "candidate_id", F.lit(None).cast("string").alias("posting_id"),
        _strings().alias("required_skills"), _strings().alias("skills"))
    return tailor_bullets(bullets, asks, per_role=None)


def coverage_partition(asked: Column | str, shown: Column | str,
                       claimed: Column | str) -> Column:
    """Asked terms split into evidenced, claimed but not shown, and missing."""
    a, s, c = T.col(asked), T.col(shown), T.col(claimed)
    return F.struct(F.array_intersect(a, s).alias("evidenced"),
                    F.array_intersect(F.array_except(a, s), c).alias("claimed_not_shown"),
                    F.array_except(F.array_except(a, s), c).alias("missing"))


def verbatim_integrity(kept: DataFrame, source: DataFrame) -> DataFrame:
    """Kept lines that are not lines of the source; must be empty."""
    return kept.join(source.select("candidate_id", "text").distinct(),
                     ["candidate_id", "text"], "left_anti")


# ---------------------------------------------------------------- W15, W16 resume scoring
_FINDING = "struct<severity:int,message:string,fixable:boolean>"


def _finding(test: Column, severity: Column | int, message: str | Column,
             fixable: bool | Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, int) else severity
    msg = F.lit(message) if isinstance(message, str) else message
    fix = F.lit(fixable) if isinstance(fixable, bool) else fixable
    return F.when(test, F.struct(sev.alias("severity"), msg.alias("message"), fix.alias("fixable")))


def _category(key: str, weight: Column | int, score: Column, findings: Sequence[Column]) -> Column:
    w = F.lit(weight) if isinstance(weight, int) else weight
    found = F.filter(F.array(*[f.cast(_FINDING) for f in findings]), lambda f: f.isNotNull())
    return F.struct(F.lit(key).alias("key"), w.cast("int").alias("weight"),
                    score.cast("int").alias("score"), found.alias("findings"))


def _grade(score: Column, good: float, fair: float) -> Column:
    """Severity 0 good, 1 warn, 2 bad."""
    return F.when(score >= good, 0).when(score >= fair, 1).otherwise(2)


def analyse_resume(profiles: DataFrame) -> DataFrame:
    """Six category scores per profile, and per posting where asked terms are given.

    ``profiles``: candidate_id, profile fields, ``skills``, ``experience`` and, for a
    targeted analysis, ``asks`` (null = no posting given) and ``posting_id``.
    A category that cannot be judged has weight 0.  All of it is array work in the row.
    """
    t = F.lit(True)
    roles = F.coalesce("experience", F.array().cast("array<" + _role_type() + ">"))
    d = (profiles.withColumn("_roles", roles)
         .withColumn("_bullets", F.flatten(F.transform("_roles", lambda r: F.coalesce(r["bullets"], _strings()))))
         .withColumn("_skills", F.coalesce("skills", _strings()))
         .withColumn("_hay", F.lower(F.array_join("_bullets", "\n"))))
    low = F.transform("_skills", lambda s: F.lower(s))
    unshown = F.filter("_skills", lambda s: ~F.contains(F.col("_hay"), F.lower(s)))
    asks = F.col("asks")
    n_asks, n_skills = F.coalesce(F.size(asks), F.lit(0)), F.size("_skills")
    hit = F.size(F.filter(asks, lambda a: F.array_contains(low, F.lower(a))))
    kw_judged = n_asks > 0
    kw = F.when(kw_judged, F.round(hit / n_asks * 100)).otherwise(0)

    shown_n = n_skills - F.size(unshown)
    ev = F.when(n_skills > 0, F.round(shown_n / n_skills * 100)).otherwise(0)
    risky = F.size(F.filter(unshown, lambda s: F.array_contains(
        F.transform(asks, lambda a: F.lower(a)), F.lower(s))))

    n_b = F.size("_bullets")
    quantified = F.size(F.filter("_bullets", lambda b: b.rlike(V.QUANTIFIED)))
    weak = F.size(F.filter("_bullets", lambda b: T.trim_ws(b).rlike(V.WEAK_OPENER)))
    strong = F.size(F.filter("_bullets", lambda b: T.trim_ws(b).rlike(V.STRONG_VERB)))
    rate = F.when(n_b > 0, quantified / n_b).otherwise(0.0)
    im = F.when(n_b > 0, F.round(F.least(F.lit(1.0), rate / F.lit(0.66)) * 100)).otherwise(0)

    n_r = F.size("_roles")
    blank = lambda c: T.trim_ws(F.coalesce(c, F.lit(""))) == ""
    undated = F.exists("_roles", lambda r: blank(r["start"]))
    thin = F.exists("_roles", lambda r: F.coalesce(F.size(r["bullets"]), F.lit(0)) < 2)
    nameless = F.exists("_roles", lambda r: blank(r["company"]))
    st = F.when(n_r == 0, 0).otherwise(
        100 - F.when(undated, 30).otherwise(0) - F.when(thin, 20).otherwise(0)
        - F.when(nameless, 20).otherwise(0))

    filled = sum((F.when(blank(F.col(f).cast("string")), 0).otherwise(1)
                  for f in V.FORM_PROFILE_FIELDS), F.lit(0))
    n_f = len(V.FORM_PROFILE_FIELDS)
    co = F.round(filled / n_f * 100)

    long_b = F.exists("_bullets", lambda b: F.length(b) > V.LONG_BULLET)
    no_contact = (F.coalesce("email", F.lit("")) == "") | (F.coalesce("phone", F.lit("")) == "")
    long_s = F.exists("_skills", lambda s: F.length(s) > V.LONG_SKILL)
    at = (100 - F.when(long_b, 15).otherwise(0) - F.when(no_contact, 30).otherwise(0)
          - F.when(long_s, 10).otherwise(0))

    categories = F.array(
        _category("keywords", F.when(kw_judged, 25).otherwise(0), kw, [
            _finding(asks.isNull(), 1, "no posting to match against", True),
            _finding(asks.isNotNull() & (n_asks == 0), 1, "the posting names no skills", False),
            _finding(kw_judged, _grade(kw, 70, 40), "skills the posting asks for", False),
            _finding(kw_judged & (hit < n_asks), 1, "asked but not in the skills list", True)]),
        _category("evidence", 20, ev, [
            _finding(n_skills == 0, 2, "no skills claimed", True),
            _finding(n_skills > 0, _grade(ev, 70, 40), "claimed skills shown in a line", False),
            _finding((n_skills > 0) & (F.size(unshown) > 0), 1, "claimed, never shown", True),
            _finding(risky > 0, 2, "asked and claimed, never shown", True)]),
        _category("impact", 20, im, [
            _finding(n_b == 0, 2, "no lines written", True),
            _finding(n_b > 0, _grade(rate, 0.5, 0.25), "lines that carry a figure", rate < 0.5),
            _finding((n_b > 0) & (weak > 0), 1, "lines that open with a duty", True),
            _finding((n_b > 0) & (strong > 0), 0, "lines that open with a result", False)]),
        _category("structure", 15, st, [
            _finding(n_r == 0, 2, "no work history", True),
            _finding(undated, 2, "roles without a start date", True),
            _finding(thin, 1, "roles with fewer than two lines", True),
            _finding(nameless, 2, "roles without an employer", True),
            _finding((n_r > 0) & ~undated & ~thin & ~nameless, 0, "roles are complete", False)]),
        _category("completeness", 10, co, [
            _finding(t, F.when(filled == n_f, 0).when(filled >= n_f - 2, 1).otherwise(2),
                     "form fields filled", False),
            _finding(filled < n_f, 1, "form fields missing", True),
            _finding(F.col("resume_name").isNull(), 2, "no document on file", True)]),
        _category("ats", 10, at, [
            _finding(t, 0, "single-column document", False),
            _finding(long_b, 1, "very long lines", True),
            _finding(no_contact, 2, "contact details incomplete", True),
            _finding(long_s, 1, "long skill phrases", True)]))
    keys = [c for c in ("candidate_id", "posting_id") if c in profiles.columns]
    return d.select(*keys, F.posexplode(categories).alias("ordinal", "c")).select(
        *keys, "ordinal", "c.*")


def _role_type() -> str:
    return ("struct<title:string,company:string,start:string,end:string,location:string,"
            "bullets:array<string>>")


def resume_score(categories: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Overall score (A14) and its band."""
    s = weighted_mean_score(categories, keys)
    return s.withColumn("band", F.when(F.col("score") >= 75, "strong")
                        .when(F.col("score") >= 50, "fair").otherwise("weak"))


def top_fixes(categories: DataFrame, keys: Sequence[str] = ("candidate_id",), n: int = 5) -> DataFrame:
    """Fixable findings, worst first, category order inside; a profile has 24 at most."""
    f = (categories.select(*keys, "ordinal", "key", F.posexplode("findings").alias("no", "f"))
         .where("f.fixable"))
    w = Window.partitionBy(*keys).orderBy(F.col("f.severity").desc(), "ordinal", "no")
    return (f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(*keys, "rank", "key", "f.severity", "f.message"))


# ---------------------------------------------------------------- P10 letter facts
def letter_facts(pairs: DataFrame) -> DataFrame:
    """P10: grounded facts with their source, shared skills, gaps and what would help.

    ``pairs``: one row per (candidate, posting): board, company, title, location of
    the posting as ``p_*``; the profile's fields as they are; ``asks`` and ``skills``.
    """
    ne = lambda c: T.blank_to_null(c).isNotNull()

    def fact(name: Column | str, value: Column, source: str) -> Column:
        n = F.lit(name) if isinstance(name, str) else name
        return F.when(T.blank_to_null(value).isNotNull(), F.struct(
            n.alias("field"), value.alias("value"), F.lit(source).alias("source")))

    employer = F.coalesce(T.blank_to_null("p_company"), T.employer_name("p_board"))
    full_name = T.trim_ws(F.concat_ws(" ", T.blank_to_null("first_name"), T.blank_to_null("last_name")))
    claimed = F.transform(F.coalesce("skills", _strings()), lambda s: F.lower(s))
    shared = F.filter(F.coalesce("asks", _strings()), lambda a: F.array_contains(claimed, F.lower(a)))
    links = F.filter(F.array("website", "github", "linkedin"), ne)
    facts = F.concat(
        F.filter(F.array(
            fact(F.when(ne(F.col("p_company")), "employer").otherwise("employer (from board)"),
                 employer, "posting"),
            fact("role title", F.col("p_title"), "posting"),
            fact("role location", F.col("p_location"), "posting"),
            fact("your name", full_name, "profile"),
            fact("current title", F.col("current_title"), "profile"),
            fact("current company", F.col("current_company"), "profile"),
            fact("your location", F.col("location"), "profile"),
            fact("email", F.col("email"), "profile"), fact("phone", F.col("phone"), "profile"),
            fact("skills you both name", F.array_join(shared, ", "), "posting")),
            lambda x: x.isNotNull()),
        F.transform(links, lambda v: F.struct(F.lit("link").alias("field"), v.alias("value"),
                                              F.lit("profile").alias("source"))))
    unsaid = ~(ne(F.col("current_title")) & ne(F.col("current_company")))
    no_name, no_contact = full_name == "", ~ne(F.col("email")) & ~ne(F.col("phone"))
    gaps = F.filter(F.array(
        F.lit("one thing you built"), F.lit("why this employer"), F.when(unsaid, "current role"),
        F.when(no_name, "your name"), F.when(no_contact, "contact")), lambda x: x.isNotNull())
    helps = F.filter(F.array(
        F.when(unsaid & ~ne(F.col("current_title")), "current_title"),
        F.when(unsaid & ~ne(F.col("current_company")), "current_company"),
        F.when(F.size(links) == 0, "website / github / linkedin"),
        F.when(no_name, "first_name / last_name"), F.when(no_contact, "email / phone")),
        lambda x: x.isNotNull())
    base = pairs.select("candidate_id", "posting_id", facts.alias("facts"), shared.alias("shared"),
                        gaps.alias("placeholders"), helps.alias("would_help"),
                        employer.alias("employer"), full_name.alias("_name"), "p_title",
                        "p_location", "current_title", "current_company", "location", "email", "phone",
                        links.alias("_links"))
    return base.withColumn("text", _letter_text()).select(
        "candidate_id", "posting_id", "facts", "shared", "placeholders", "would_help", "text")


def _and_join(items: Column) -> Column:
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "),
                 F.try_element_at(items, n)))


def _letter_text() -> Column:
    """The starter letter: fact lines where there are facts, bracketed prompts where not."""
    place = T.blank_to_null("location")
    head = F.try_element_at(F.split(T.trim_ws("p_location"), "[,;]", -1), F.lit(1))
    where = F.when((T.trim_ws(F.coalesce("p_location", F.lit(""))) != "")
                   & ~((T.trim_ws(head) != "") & F.contains(F.lower("p_title"), F.lower(T.trim_ws(head)))),
                   F.concat(F.lit(" ("), T.trim_ws("p_location"), F.lit(")"))).otherwise("")
    n = F.size("shared")
    overlap = F.when(n > 0, F.concat(
        F.lit("The posting asks for "), _and_join(F.slice("shared", 1, 4)),
        F.when(n > 4, " among others").otherwise(""), F.lit("; I list "),
        F.when(n == 1, "it").otherwise("them"), F.lit(" on my CV.")))
    based = F.when(place.isNotNull(), F.concat(F.lit(", based in "), place)).otherwise("")
    now = F.when(T.blank_to_null("current_title").isNotNull() & T.blank_to_null("current_company").isNotNull(),
                 F.concat(F.lit("I am currently "), "current_title", F.lit(" at "), "current_company", based,
                          F.lit("."))).otherwise(F.concat(F.lit("[Your current role]"), based, F.lit(".")))
    links = F.when(F.size("_links") > 0, F.concat(F.lit("My work is at "), _and_join(F.col("_links")),
                                                  F.lit(".")))
    contact = F.concat_ws(" · ", T.blank_to_null("email"), T.blank_to_null("phone"))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Dear "), "employer", F.lit(" hiring team,")),
        F.concat(F.lit("I am applying for the "), "p_title", F.lit(" role"), where, F.lit(".")),
        overlap, F.lit("[One thing you have built, shipped or measured that fits this role]"),
        F.lit("[Why this employer in particular]"), now, links, F.lit("Thank you for your time."),
        F.when(F.col("_name") == "", "[Your name]").otherwise(F.col("_name")),
        F.when(contact == "", "[How to reach you]").otherwise(contact))


# ---------------------------------------------------------------- V1, V2 rewordings
def verify_rewordings(pairs: DataFrame, vocab: Iterable[str]) -> DataFrame:
    """V1: ``objections array<struct<kind, detail>>`` for (original, proposal) rows."""
    vocab = list(vocab)
    d = (pairs.withColumn("_from", T.trim_ws(F.coalesce("original", F.lit(""))))
         .withColumn("_to", T.trim_ws(F.coalesce("proposal", F.lit("")))))
    for side in ("from", "to"):
        c = F.col("_" + side)
        d = (d.withColumn(f"_{side}_n", T.numbers_in(c)).withColumn(f"_{side}_t", T.terms_in(c, vocab))
             .withColumn(f"_{side}_p", T.proper_nouns_in(c)).withColumn(f"_{side}_c", T.credit_groups_in(c))
             .withColumn(f"_{side}_w", F.size(F.filter(F.split(c, r"\s+", -1), lambda w: w != ""))))
    lower = lambda a: F.transform(a, lambda x: F.lower(x))
    known = F.array_union(lower("_from_p"), F.col("_from_t"))
    entities = F.filter("_to_p", lambda n: ~F.array_contains(known, F.lower(n))
                        & (F.size(T.terms_in(n, vocab)) == 0))

    def objections(kind: str, details: Column) -> Column:
        return F.transform(details, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("detail")))

    inflated = F.when(F.col("_to_w") > F.ceil(F.col("_from_w") * 1.5) + 2, F.array(F.concat(
        F.col("_from_w").cast("string"), F.lit(" words became "), F.col("_to_w").cast("string"))))
    every = F.concat(
        objections("new-number", F.array_except("_to_n", "_from_n")),
        objections("dropped-number", F.array_except("_from_n", "_to_n")),
        objections("new-technology", F.array_except("_to_t", "_from_t")),
        objections("dropped-technology", F.array_except("_from_t", "_to_t")),
        objections("new-entity", entities),
        objections("escalation", F.array_except("_to_c", "_from_c")),
        objections("inflated", F.coalesce(inflated, _strings())))
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    out = (F.when(F.col("_to") == "", objections("empty", F.array(F.lit("blank"))))
           .when(flat(F.col("_to")) == flat(F.col("_from")),
                 objections("unchanged", F.array(F.lit("identical"))))
           .otherwise(every))
    return d.select(*pairs.columns, out.alias("objections")).withColumn(
        "ok", F.size("objections") == 0)


def triage_proposals(proposals: DataFrame, bullets: DataFrame,
                     vocab: Iterable[str]) -> DataFrame:
    """V2 (with J10): proposals of known bullets, first per id, as suggested or discarded.

    Blank and unchanged proposals are neither and drop out.
    """
    one = proposals.groupBy("bullet_id").agg(F.min_by(F.struct("proposal", "why"), "ord").alias("p"))
    j = one.join(bullets.select("bullet_id", F.col("text").alias("original")), "bullet_id").select(
        "bullet_id", "original", F.col("p.proposal").alias("proposal"), F.col("p.why").alias("why"))
    # Equal texts with equal proposals are checked once.
    j = materialise(j)
    once = materialise(verify_rewordings(j.select("original", "proposal").distinct(), vocab)).select(
        F.col("original").alias("_o"), F.col("proposal").alias("_p"), "objections", "ok")
    v = j.join(once, F.col("original").eqNullSafe(F.col("_o")) & F.col("proposal").eqNullSafe(F.col("_p"))).drop("_o", "_p")
    quiet = F.exists("objections", lambda o: o["kind"].isin("empty", "unchanged"))
    return (v.where(F.col("ok") | ~quiet)
            .withColumn("verdict", F.when(F.col("ok"), "suggested").otherwise("discarded"))
            .withColumn("proposal", T.trim_ws("proposal")).withColumn("why", T.trim_ws("why")))


# ---------------------------------------------------------------- V3 history
def bullet_history(events: DataFrame, bullets: DataFrame) -> DataFrame:
    """V3: accept / revert log to current text, original text and time of acceptance.

    ``events``: bullet_id, seq, ts, action, text.  State after the log needs only the
    last revert and the last accept after it, so aggregates do and nothing is folded.
    """
    accept = F.col("action") == "accept"
    last_revert = events.groupBy("bullet_id").agg(
        F.max(F.when(F.col("action") == "revert", F.col("seq"))).alias("_r"))
    run = (events.join(last_revert, "bullet_id")
           .where(accept & (F.col("_r").isNull() | (F.col("seq") > F.col("_r"))))
           .groupBy("bullet_id").agg(F.max_by(F.struct("text", "ts"), "seq").alias("l"),
                                     F.count("*").alias("accepts")))
    j = bullets.join(run, "bullet_id", "left")
    on = F.col("l").isNotNull()
    return j.select("bullet_id", F.coalesce("l.text", "text").alias("text"),
                    F.when(on, F.col("text")).alias("original_text"),
                    F.when(on, F.col("l.ts")).alias("accepted_at"),
                    F.coalesce("accepts", F.lit(0)).alias("accepts"))
