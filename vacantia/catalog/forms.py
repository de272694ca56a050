"""Plans, kits and worklists: P1-P11, A11-A13, W6, W10, J4."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.counting import _CORPUS
from vacantia.catalog.labels import VALUE_SQL
from vacantia.catalog.registry import query
from vacantia.operators import planning as P
from vacantia.operators import score as W
from vacantia.operators import stats as A
from vacantia.operators import tracking as K


def _plan(spark, d):
    return _plan_of(spark, d, D.questions(spark, d))


def _plan_of(spark, d, questions):
    return P.compile_plan(questions, D.candidates(spark, d, with_skills=False), D.bank(spark, d))


def _plan_and_sizes(spark, d):
    """The plan and the sizes of its forms, from questions that are stored once."""
    q = D.questions(spark, d)
    return _plan_of(spark, d, q), q.groupBy("posting_id").agg(F.count("*").alias("form_fields"))


def _pick(prefs: list[str], opts: str) -> str:
    """First option in the ladder for literal preferences, over a list expression of options."""
    arms = []
    for pref in prefs:
        pc = Q.canon(pref)
        tests = [f"o = {pref}", f"{Q.canon('o')} = {pc}", f"{Q.synonym(Q.canon('o'))} = {Q.synonym(pc)}",
                 f"length({pc}) >= 4 AND (contains({Q.canon('o')}, {pc}) OR contains({pc}, {Q.canon('o')}))"]
        arms += [f"CASE WHEN {pc} <> '' THEN list_filter({opts}, lambda o: {t})[1] END" for t in tests]
    return f"coalesce({', '.join(arms)})"


# The ladder of the plan written as SQL over one row per field.
_HAS = Q.has
PLAN_SQL = (
    f"pl0 AS (SELECT qc.*, cands0.* EXCLUDE (candidate_id), c_mktsegment, c_acctbal, {Q.profile_field('label_key')} AS pf, "
    "CASE WHEN opts <> '' THEN string_split(opts, '|') ELSE []::VARCHAR[] END AS os, "
    f"CASE WHEN answerability = 'demographic' THEN 'demographic' WHEN {_HAS('label_key', Q.any_of(V.NO_AI_PATTERNS))} THEN 'no generated answer' "
    f"WHEN {_HAS('label_key', Q.any_of(V.HEALTH_PATTERNS))} THEN 'health' WHEN {_HAS('label_key', Q.any_of(V.CONSENT_PATTERNS))} THEN 'consent' END AS people "
    "FROM qc JOIN cands0 USING (candidate_id) JOIN customer ON c_custkey = candidate_id)",
    f"pl1 AS (SELECT *, nullif(trim({VALUE_SQL.replace('CASE field', 'CASE pf')}), '') AS pv, "
    "CASE WHEN label_key = 'how did you hear about this job' THEN 0 WHEN contains(label_key, 'sponsor') OR contains(label_key, 'authorized to work') THEN 1 "
    "WHEN label_key LIKE 'notice%' AND c_acctbal >= 0 THEN 2 WHEN contains(label_key, 'have you worked with') THEN 3 END AS be, "
    "label_key IN ('how did you hear about this job', 'are you legally authorized to work in the country') OR label_key = 'notice period' AS be_exact, "
    "CASE WHEN kinds = 'file+long_text' AND people IS NULL THEN ['long_text'] ELSE string_split(kinds, '+') END AS ks, kinds = 'file+long_text' AND people IS NULL AS pair FROM pl0)",
    "pl2 AS (SELECT *, unnest(ks) AS kind, unnest(range(len(ks))) AS field_no FROM pl1)",
    f"pl3 AS (SELECT *, fname || CASE WHEN kind = 'long_text' THEN '_text' ELSE '' END AS field_name, "
    f"CASE WHEN pv IS NOT NULL THEN {_pick(['pv'], 'os')} END AS popt, CASE be WHEN 0 THEN {_pick([Q.lit('LinkedIn job posting'), Q.lit('Job Board')], 'os')} "
    f"WHEN 1 THEN {_pick([Q.lit('Yes')], 'os')} WHEN 2 THEN NULL WHEN 3 THEN {_pick([Q.lit('Never'), Q.lit('no')], 'os')} END AS bopt FROM pl2)",
    f"""plan0 AS (SELECT *, CASE WHEN people IS NOT NULL THEN 'user' WHEN kind = 'unknown' AND {_HAS('field_name', V.INERT_FIELD)} THEN 'drop'
      WHEN (pair OR kind = 'file') AND contains(label_key, 'cover letter') THEN 'generated'
      WHEN pair OR kind = 'file' OR answerability = 'file' THEN CASE WHEN resume_name IS NOT NULL THEN 'file' ELSE 'unresolved' END
      WHEN pv IS NOT NULL THEN CASE WHEN kind = 'single_select' AND popt IS NULL THEN 'user' ELSE 'profile' END
      WHEN NOT required AND pf IS NOT NULL THEN 'drop' WHEN be = 1 AND NOT be_exact THEN 'user'
      WHEN be IS NOT NULL AND kind = 'single_select' THEN CASE WHEN bopt IS NULL THEN 'user' ELSE 'bank' END
      WHEN be IS NOT NULL THEN 'bank' WHEN answerability = 'generated' THEN 'generated'
      WHEN {_HAS('label_key', V.FOLLOW_UP_QUESTION)} THEN 'user' ELSE 'unresolved' END AS source FROM pl3)""",
    """plan AS (SELECT *, CASE WHEN people IS NOT NULL THEN NULL WHEN source = 'file' THEN resume_name
      WHEN source = 'profile' THEN CASE WHEN kind = 'single_select' THEN popt ELSE pv END WHEN source = 'user' AND pv IS NOT NULL THEN pv
      WHEN source = 'bank' THEN CASE WHEN kind = 'single_select' THEN bopt WHEN be = 2 THEN length(c_mktsegment) || ' weeks'
        WHEN be = 0 THEN 'LinkedIn job posting' WHEN be = 1 THEN 'Yes' ELSE 'Never' END END AS value FROM plan0 WHERE source <> 'drop')""")
PLAN = D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL)
_SIZES = "sizes AS (SELECT posting_id, count(*) AS form_fields FROM qc GROUP BY 1)"


@query("compile_plan", PLAN + """SELECT candidate_id, posting_id, position::INTEGER AS position, field_no::INTEGER AS field_no, field_name, kind, source, value FROM plan""")
def compile_plan(spark, d):
    return _plan(spark, d).select("candidate_id", "posting_id", "position", "field_no", "field_name", "kind", "source", "value")


@query("attachment_pairs", PLAN + """SELECT posting_id, position::INTEGER AS position, field_name, source FROM plan
  WHERE label_key = 'cover letter' OR kind = 'file'""")
def attachment_pairs(spark, d):
    return _plan(spark, d).where((F.col("label_key") == "cover letter") | (F.col("kind") == "file")).select(
        "posting_id", "position", "field_name", "source")


@query("executable_forms", PLAN + """SELECT posting_id, count(*) FILTER (WHERE source = 'unresolved' AND required) AS blocking,
  count(*) FILTER (WHERE source = 'generated') AS to_write, count(*) FILTER (WHERE source = 'unresolved' AND required) = 0
   AND count(*) FILTER (WHERE source = 'generated') = 0 AS executable FROM plan GROUP BY 1""")
def executable_forms(spark, d):
    return P.executable(_plan(spark, d)).select("posting_id", "blocking", "to_write", "executable")


_BY_SRC = ", ".join(f"count(*) FILTER (WHERE source = '{s}') AS n_{s}" for s in ("profile", "bank", "file", "generated", "user", "unresolved"))
_COUNTS = f"""cnt AS (SELECT posting_id, count(*) AS planned, count(*) FILTER (WHERE source IN ('profile', 'bank', 'file')) AS deterministic, {_BY_SRC},
    count(*) FILTER (WHERE source = 'unresolved' AND required) AS blocking FROM plan GROUP BY 1)"""


@query("plan_counts", D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL, _SIZES, _COUNTS)
       + "SELECT cnt.*, form_fields, greatest(form_fields - planned, 0) AS skipped_optional, blocking = 0 AND n_generated = 0 AS executable FROM cnt JOIN sizes USING (posting_id)")
def plan_counts(spark, d):
    return A.plan_counts(*_plan_and_sizes(spark, d)).drop("candidate_id")


@query("plan_summary", D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL, _SIZES, _COUNTS) + """SELECT count(*) AS plans, sum(planned)::BIGINT AS actions,
  sum(n_profile)::BIGINT AS n_profile, sum(n_bank)::BIGINT AS n_bank, sum(n_file)::BIGINT AS n_file, sum(n_generated)::BIGINT AS n_generated,
  sum(n_user)::BIGINT AS n_user, sum(n_unresolved)::BIGINT AS n_unresolved,
  count(*) FILTER (WHERE n_generated = 0 AND n_user = 0 AND blocking = 0) AS fully_deterministic, count(*) FILTER (WHERE blocking > 0) AS blocked_forms,
  count(*) FILTER (WHERE n_user > 0) AS needs_user_forms, count(*) FILTER (WHERE n_generated > 0) AS needs_writing_forms FROM cnt""")
def plan_summary(spark, d):
    return A.plan_summary(A.plan_counts(*_plan_and_sizes(spark, d)))


@query("readiness", PLAN + """SELECT posting_id, count(*) FILTER (WHERE source IN ('profile', 'bank', 'file')) AS filled, count(*) AS total,
  round(count(*) FILTER (WHERE source IN ('profile', 'bank', 'file')) / count(*), 6) AS pct,
  count(*) FILTER (WHERE source = 'unresolved' AND required) > 0 AS blocked, count(*) FILTER (WHERE source = 'generated') AS needs_writing FROM plan GROUP BY 1""")
def readiness(spark, d):
    return W.readiness(_plan(spark, d)).select("posting_id", "filled", "total", F.round("pct", 6).alias("pct"), "blocked", "needs_writing")


# ---------------------------------------------------------------- P4-P9
_STATE = "CASE WHEN form_fetched_at IS NULL THEN 'unread' WHEN form_readable THEN 'readable' ELSE 'unpublished' END"


@query("form_state", D.with_ctes(D.POSTS_PLAIN) + f"SELECT posting_id, {_STATE} AS state FROM posts")
def form_state(spark, d):
    return D.postings(spark, d, with_skills=False).select("posting_id", P.form_state().alias("state"))


def _attachments(spark, d):
    return D.candidates(spark, d, with_skills=False).where(F.col("resume_name").isNotNull()).select("candidate_id", "resume_name")


_BUCKET = """CASE WHEN source = 'file' THEN CASE WHEN resume_name IS NOT NULL THEN 'answers' ELSE 'open' END WHEN source IN ('profile', 'bank') THEN 'answers'
  WHEN source = 'user' THEN 'yours' ELSE 'open' END"""
_BUCKETS = f"""bk AS (SELECT candidate_id, posting_id, count(*) FILTER (WHERE b = 'answers') AS prepared, count(*) FILTER (WHERE b = 'yours') AS yours,
    count(*) FILTER (WHERE b = 'open') AS open, count(*) AS stated FROM (SELECT *, {_BUCKET} AS b FROM plan) GROUP BY 1, 2)"""


@query("action_buckets", PLAN + f"SELECT posting_id, {_BUCKET} AS bucket, count(*) AS n FROM plan GROUP BY 1, 2")
def action_buckets(spark, d):
    has = _attachments(spark, d).select("candidate_id", F.lit(True).alias("h"))
    return (_plan(spark, d).join(has, "candidate_id", "left")
            .groupBy("posting_id", P.bucket("source", F.coalesce("h", F.lit(False))).alias("bucket")).agg(F.count("*").alias("n")))


def _run_postings(spark, d):
    p = D.postings(spark, d, with_skills=False)
    return p.select(F.col("owner_id").alias("candidate_id"), "posting_id", "form_fetched_at", "form_readable")


_RUN = f"""run AS (SELECT owner_id AS candidate_id, posting_id, CASE {_STATE} WHEN 'unread' THEN 'form not read yet' WHEN 'unpublished' THEN 'no readable form' END AS reason,
    prepared, yours, open, form_fields, posted_at FROM posts LEFT JOIN bk USING (posting_id) LEFT JOIN sizes USING (posting_id))"""
_RUNQ = D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL, _SIZES, _BUCKETS, D.POSTS_PLAIN, _RUN)


@query("run_row", _RUNQ.replace("'no readable form' END AS reason", "'no readable form' ELSE CASE WHEN closed_at IS NOT NULL THEN 'no longer indexed' END END AS reason") + """SELECT candidate_id, posting_id, reason, CASE WHEN reason IS NULL THEN coalesce(prepared, 0) END AS prepared,
  CASE WHEN reason IS NULL THEN coalesce(yours, 0) END AS yours, CASE WHEN reason IS NULL THEN coalesce(open, 0) END AS open,
  CASE WHEN reason IS NULL THEN coalesce(form_fields, 0) END AS fields FROM run""")
def run_row(spark, d):
    still = D.postings(spark, d, with_skills=False).where(F.col("closed_at").isNull())
    return P.run_row(_run_postings(spark, d), *_plan_and_sizes(spark, d), _attachments(spark, d), still).select(
        "candidate_id", "posting_id", "reason", "prepared", "yours", "open", "fields")


@query("expected_questions", D.with_ctes(D.POSTS_PLAIN) + """SELECT posting_id, label, source, value FROM posts JOIN customer ON owner_id = c_custkey JOIN (VALUES
    (0, 'How did you hear about this job', 'bank', 'LinkedIn job posting'), (1, 'Are you legally authorized to work in the country', 'bank', 'Yes'),
    (2, 'Notice period', 'bank', NULL), (9, 'Resume/CV', 'file', NULL)) v(k, label, source, val) ON k IN (0, 1) OR c_acctbal >= 0,
  LATERAL (SELECT CASE WHEN k = 2 THEN length(c_mktsegment) || ' weeks' ELSE val END AS value) WHERE form_fetched_at IS NULL""")
def expected_questions(spark, d):
    unread = _run_postings(spark, d).where(P.form_state() == "unread")
    return P.expected_questions(unread, D.bank(spark, d), _attachments(spark, d)).select("posting_id", "label", "source", "value")


@query("answer_once", D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL) + """SELECT posting_id, position::INTEGER AS position, label_key,
  CASE WHEN contains(lower(label), 'notice') THEN 'Notice Ltd' END AS employer FROM plan WHERE source = 'unresolved' AND answerability = 'bank'""")
def answer_once(spark, d):
    firms = D.postings(spark, d, with_skills=False).select("posting_id", F.lit("Notice Ltd").alias("company"))
    return P.answer_once(_plan(spark, d), firms).select("posting_id", "position", "label_key", "employer")


@query("guard_bank", D.with_ctes(*_CORPUS[:4]) + f"SELECT label_key, NOT {Q.human_only('label_key')} AS accepted, count(*) AS n FROM qc GROUP BY ALL")
def guard_bank(spark, d):
    keys = D.questions(spark, d).groupBy("label_key").agg(F.count("*").alias("n"))
    return P.guard_bank(keys).select("label_key", "accepted", "n")


# ---------------------------------------------------------------- J4, W10, P11, A13
def _ranked(spark, d):
    from pyspark.sql import Window

    p = D.postings(spark, d, with_skills=False)
    w = Window.partitionBy("owner_id").orderBy(F.col("posted_at").desc(), "posting_id")
    return p.select(F.col("owner_id").alias("candidate_id"), "posting_id", F.row_number().over(w).alias("rank"),
                    "form_fetched_at", "form_readable")


def _done(spark, d):
    p = D.postings(spark, d, with_skills=False)
    return p.select(F.col("owner_id").alias("candidate_id"), "posting_id",
                    F.when(F.col("level") == "junior", "APPLIED").otherwise("SAVED").alias("status"))


_LEFT = """lft AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY posted_at DESC, posting_id) AS run_no,
    count(*) OVER (PARTITION BY owner_id) AS available FROM posts WHERE coalesce(level, '') <> 'junior')"""


@query("worklist", D.with_ctes(D.POSTS_PLAIN, _LEFT) + "SELECT owner_id AS candidate_id, posting_id, run_no::INTEGER AS run_no, available FROM lft WHERE run_no <= 3")
def worklist(spark, d):
    return P.worklist(_ranked(spark, d), _done(spark, d), 3).select("candidate_id", "posting_id", "run_no", "available")


@query("worklist_totals", D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL, _SIZES, _BUCKETS, D.POSTS_PLAIN, _RUN, _LEFT)
       + """SELECT run.candidate_id, coalesce(sum(prepared) FILTER (WHERE reason IS NULL), 0)::BIGINT AS prepared,
  coalesce(sum(yours) FILTER (WHERE reason IS NULL), 0)::BIGINT AS yours, coalesce(sum(open) FILTER (WHERE reason IS NULL), 0)::BIGINT AS open,
  count(reason) AS could_not_prepare, max(available) AS available FROM lft JOIN run USING (posting_id) WHERE run_no <= 3 GROUP BY 1""")
def worklist_totals(spark, d):
    wl = P.worklist(_ranked(spark, d), _done(spark, d), 3)
    rows = P.run_row(wl, *_plan_and_sizes(spark, d), _attachments(spark, d))
    return P.worklist_totals(rows)


@query("kit_counts", D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL, _SIZES, _BUCKETS) + """SELECT posting_id, prepared, yours, open, stated,
  CASE WHEN form_fields > 0 THEN floor(stated / form_fields * 100 + 0.5)::INTEGER END AS coverage, greatest(form_fields - stated, 0) AS skipped_optional_blank
  FROM bk JOIN sizes USING (posting_id)""")
def kit_counts(spark, d):
    plan, sizes = _plan_and_sizes(spark, d)
    return P.kit_counts(plan, _attachments(spark, d), sizes).select(
        "posting_id", "prepared", "yours", "open", "stated", "coverage", "skipped_optional_blank")


@query("kit", D.with_ctes(*_CORPUS[:4], D.CANDS_PLAIN, *PLAN_SQL, f"b AS (SELECT *, {_BUCKET} AS bkt FROM plan)") + """SELECT posting_id,
  coalesce(string_agg(label || '=' || coalesce(value, ''), '|' ORDER BY position, field_no) FILTER (WHERE bkt = 'answers'), '') AS answers,
  coalesce(string_agg(label, '|' ORDER BY position, field_no) FILTER (WHERE bkt = 'yours'), '') AS yours_labels,
  coalesce(string_agg(label, '|' ORDER BY position, field_no) FILTER (WHERE bkt = 'open'), '') AS open_labels FROM b GROUP BY 1""")
def kit(spark, d):
    plan, sizes = _plan_and_sizes(spark, d)
    k = P.kit(plan, _attachments(spark, d), sizes)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), "|")
    return k.select("posting_id", F.array_join(F.transform("answers", lambda x: F.concat(
        x["label"], F.lit("="), F.coalesce(x["value"], F.lit("")))), "|").alias("answers"),
        names("your_answers").alias("yours_labels"), names("open_items").alias("open_labels"))


# ---------------------------------------------------------------- X3's batch view feeds J3 and the tracker
@query("application_state", D.with_ctes(D.APPS) + "SELECT candidate_id, posting_id, status, updated_at, created_at, sent_at FROM apps")
def application_state(spark, d):
    return K.application_state(D.app_events(spark, d))
