"""Statistics and gap reports: A1-A10, A15 (A11-A14 stand beside their plans)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.labels import VALUE_SQL
from vacantia.catalog.registry import query
from vacantia.functions import text as T
from vacantia.operators import stats as A
from vacantia.operators import tracking as K
from vacantia.session import materialise


def _line_questions(spark, d):
    """Every line of every text as a question; a line that ends a sentence is required."""
    t = D.text_lines(spark, d)
    return A.label_counts(t.withColumn("required", F.col("label").endswith(".")).withColumn("kinds", F.lit("short_text")))


_LQ = f"lq AS (SELECT *, {Q.label_key('label')} AS label_key, label LIKE '%.' AS required FROM tlines)"
_LQC = f"lc AS (SELECT *, {Q.classify('label_key', chr(39) + 'short_text' + chr(39))} AS answerability FROM lq)"


@query("question_stats_lines", D.with_ctes(D.TEXT_LINES, _LQ, _LQC) + """SELECT label_key, answerability, count(*) AS n,
  count(*) FILTER (WHERE required) AS n_required FROM lc GROUP BY 1, 2""")
def question_stats_lines(spark, d):
    return A.stats_of_labels(_line_questions(spark, d))


@query("common_phrasing_lines", D.with_ctes(D.TEXT_LINES, _LQ) + """SELECT label_key, arg_min(label, (-c, label)) AS label FROM (
  SELECT label_key, label, count(*) AS c FROM lq GROUP BY 1, 2) GROUP BY 1""")
def common_phrasing_lines(spark, d):
    return A.phrasing_of_labels(_line_questions(spark, d))


_Q = ("q AS (SELECT *, " + Q.label_key("label") + " AS label_key FROM qraw)",
      "qc AS (SELECT *, " + Q.classify("label_key", "kinds") + " AS answerability FROM q)")
_CORPUS = (D.LINES, D.QUESTIONS_RAW, *_Q,
           "st AS (SELECT label_key, answerability, count(*) AS n, count(*) FILTER (WHERE required) AS n_required FROM qc GROUP BY 1, 2)",
           "rk AS (SELECT label_key, sum(n_required)::BIGINT AS required_count FROM st GROUP BY 1)",
           "ph AS (SELECT label_key, arg_min(label, (-c, label)) AS label FROM (SELECT label_key, label, count(*) AS c FROM qc GROUP BY 1, 2) GROUP BY 1)",
           f"corpus AS (SELECT st.*, {Q.route('label_key', 'answerability')} AS route, {Q.profile_field('label_key')} AS pf, required_count, label "
           "FROM st JOIN rk USING (label_key) JOIN ph USING (label_key))")


@query("question_stats", D.with_ctes(*_CORPUS) + "SELECT label_key, answerability, n, n_required FROM st")
def question_stats(spark, d):
    return A.question_stats(D.questions(spark, d))


@query("question_reach", D.with_ctes(*_CORPUS) + "SELECT label_key, count(DISTINCT posting_id) AS n_postings FROM qc GROUP BY 1")
def question_reach(spark, d):
    return A.question_reach(D.questions(spark, d))


@query("common_phrasing", D.with_ctes(*_CORPUS) + "SELECT label_key, label FROM ph")
def common_phrasing(spark, d):
    return A.common_phrasing(D.questions(spark, d))


@query("required_by_key", D.with_ctes(*_CORPUS) + "SELECT label_key, required_count FROM rk")
def required_by_key(spark, d):
    return A.required_by_key(A.question_stats(D.questions(spark, d)))


@query("route_question", D.with_ctes(*_CORPUS) + "SELECT label_key, answerability, route, CASE WHEN route = 'profile' THEN pf END AS profile_field FROM corpus")
def route_question(spark, d):
    return _corpus(spark, d).select("label_key", "answerability", "route", "profile_field")


_ANS = f"""ans AS (SELECT candidate_id, label_key FROM (SELECT c_custkey AS candidate_id, c_acctbal FROM customer) JOIN
   (SELECT DISTINCT label_key FROM corpus WHERE route = 'bank') ON label_key = 'how did you hear about this job' OR contains(label_key, 'sponsor')
   OR contains(label_key, 'authorized to work') OR (label_key LIKE 'notice%' AND c_acctbal >= 0) OR contains(label_key, 'have you worked with')),
  pv AS (SELECT candidate_id, pf AS field, {VALUE_SQL.replace('CASE field', 'CASE pf')} AS v FROM cands0 JOIN (SELECT DISTINCT pf FROM corpus WHERE route = 'profile') ON true)"""


def _corpus(spark, d):
    return A.corpus_gaps(A.label_counts(D.question_wordings(spark, d)))


def _answers(spark, d):
    """Answers for the keys a candidate's own forms ask."""
    return A.bank_matches(D.questions(spark, d).select("candidate_id", "label_key"), D.bank(spark, d))


@query("gap_report", D.with_ctes(*_CORPUS, D.CANDS_PLAIN, _ANS) + """SELECT candidate_id, kind, gap_rank::INTEGER AS gap_rank, label_key, label, n_instances, required_count, profile_field FROM (
  SELECT candidate_id, CASE route WHEN 'bank' THEN 'bankable' ELSE route END AS kind, label_key, label, n AS n_instances, required_count,
    CASE WHEN route = 'profile' THEN pf END AS profile_field,
    row_number() OVER (PARTITION BY candidate_id, route ORDER BY n DESC, label_key, answerability) AS gap_rank
  FROM corpus JOIN cands0 ON route <> 'skip' LEFT JOIN ans USING (candidate_id, label_key)
  LEFT JOIN pv ON pv.candidate_id = cands0.candidate_id AND route = 'profile' AND pv.field = pf
  WHERE (route <> 'bank' OR ans.label_key IS NULL) AND (route <> 'profile' OR pv.v IS NULL)) WHERE gap_rank <= 5""".replace(
      "LEFT JOIN ans USING (candidate_id, label_key)", "LEFT JOIN ans ON ans.candidate_id = cands0.candidate_id AND ans.label_key = corpus.label_key").replace(
      "SELECT candidate_id, CASE route", "SELECT cands0.candidate_id, CASE route").replace("END AS kind, label_key,", "END AS kind, corpus.label_key,").replace(
      "PARTITION BY candidate_id, route ORDER BY n DESC, label_key", "PARTITION BY cands0.candidate_id, route ORDER BY n DESC, corpus.label_key"))
def gap_report(spark, d):
    corpus = materialise(_corpus(spark, d))
    p = D.candidates(spark, d, with_skills=False)
    classes, answers = A.answer_classes(corpus, D.bank(spark, d))
    return A.gap_report(corpus, p, answers, 5, classes)


@query("gap_report_corpus", D.with_ctes(*_CORPUS) + """SELECT CASE route WHEN 'bank' THEN 'bankable' ELSE route END AS kind, label_key, answerability, label,
  n AS n_instances, required_count, CASE WHEN route = 'profile' THEN pf END AS profile_field FROM corpus WHERE route <> 'skip'""")
def gap_report_corpus(spark, d):
    return A.gap_report_corpus(_corpus(spark, d))


@query("gap_report_answered", D.with_ctes(*_CORPUS, D.CANDS_PLAIN, _ANS) + """SELECT candidate_id, 'bankable' AS kind, label_key, NULL AS profile_field,
  CASE WHEN label_key LIKE 'notice%' THEN length(c_mktsegment) || ' weeks' END AS answer FROM ans JOIN customer ON candidate_id = c_custkey
  UNION ALL SELECT candidate_id, 'profile', NULL, field, NULL FROM pv WHERE v IS NOT NULL""")
def gap_report_answered(spark, d):
    corpus = materialise(_corpus(spark, d))
    return A.gap_report_answered(corpus, D.candidates(spark, d, with_skills=False), D.bank(spark, d))


@query("gap_report_totals", D.with_ctes(*_CORPUS, D.CANDS_PLAIN, _ANS, D.POSTS_PLAIN) + """SELECT candidate_id,
  (SELECT count(*) FROM posts WHERE form_fetched_at IS NOT NULL AND form_readable) AS forms_read, (SELECT sum(n) FROM corpus)::BIGINT AS total_questions,
  ((SELECT sum(n) FROM corpus WHERE route = 'profile') - coalesce((SELECT sum(n) FROM corpus JOIN pv ON pf = field WHERE route = 'profile'
     AND pv.candidate_id = c.candidate_id AND v IS NOT NULL), 0))::BIGINT AS profile_reach,
  ((SELECT sum(n) FROM corpus WHERE route = 'bank') - coalesce((SELECT sum(n) FROM corpus JOIN ans ON ans.label_key = corpus.label_key
     WHERE route = 'bank' AND ans.candidate_id = c.candidate_id), 0))::BIGINT AS bankable_reach FROM cands0 c""")
def gap_report_totals(spark, d):
    corpus = materialise(_corpus(spark, d))
    classes, answers = A.answer_classes(corpus, D.bank(spark, d))
    return A.gap_report_totals(corpus, D.candidates(spark, d, with_skills=False), answers, D.postings(spark, d, with_skills=False), classes)


@query("gap_reach", D.with_ctes(*_CORPUS, D.CANDS_PLAIN, _ANS) + """SELECT candidate_id,
  ((SELECT sum(n) FROM corpus WHERE route = 'profile') - coalesce((SELECT sum(n) FROM corpus JOIN pv ON pf = field WHERE route = 'profile'
     AND pv.candidate_id = c.candidate_id AND v IS NOT NULL), 0))::BIGINT AS profile_reach,
  ((SELECT sum(n) FROM corpus WHERE route = 'bank') - coalesce((SELECT sum(n) FROM corpus JOIN ans ON ans.label_key = corpus.label_key
     WHERE route = 'bank' AND ans.candidate_id = c.candidate_id), 0))::BIGINT AS bankable_reach FROM cands0 c""")
def gap_reach(spark, d):
    corpus = materialise(_corpus(spark, d))
    classes, answers = A.answer_classes(corpus, D.bank(spark, d))
    return A.gap_reach(corpus, D.candidates(spark, d, with_skills=False), answers, classes)


@query("answered_gaps", D.with_ctes(*_CORPUS, f"""asked AS (SELECT DISTINCT candidate_id, label_key FROM qc)""")
       + """SELECT candidate_id, asked.label_key, CASE WHEN asked.label_key LIKE 'notice%' THEN length(c_mktsegment) || ' weeks' END AS answer, n AS n_instances
  FROM asked JOIN customer ON candidate_id = c_custkey JOIN corpus ON corpus.label_key = asked.label_key AND route = 'bank'
  WHERE asked.label_key = 'how did you hear about this job' OR contains(asked.label_key, 'sponsor') OR contains(asked.label_key, 'authorized to work')
   OR (asked.label_key LIKE 'notice%' AND c_acctbal >= 0) OR contains(asked.label_key, 'have you worked with')""")
def answered_gaps(spark, d):
    corpus = A.corpus_gaps(D.questions(spark, d))
    return A.answered_gaps(corpus, _answers(spark, d)).select("candidate_id", "label_key", "answer", "n_instances")


@query("answer_unlocks", D.with_ctes(*_CORPUS) + "SELECT label_key, count(*) AS unlocks FROM qc GROUP BY 1")
def answer_unlocks(spark, d):
    return A.answer_unlocks(D.questions(spark, d))


@query("group_paraphrases", D.with_ctes(*_CORPUS) + f"""SELECT {Q.squeeze(Q.sub('label_key', V.PARAPHRASE_NOUN, ''))} AS stem, arg_min(label, (-n, label_key)) AS label,
  sum(n)::BIGINT AS n, count(*) AS n_keys FROM (SELECT label_key, max(label) AS label, sum(n)::BIGINT AS n FROM corpus GROUP BY 1)
  WHERE NOT {Q.has('label_key', V.FOLLOW_UP_QUESTION)} GROUP BY 1""")
def group_paraphrases(spark, d):
    c = _corpus(spark, d).groupBy("label_key").agg(F.max("label").alias("label"), F.sum("n").alias("n"))
    return A.group_paraphrases(c)


_CURVE = """SELECT max(total)::BIGINT AS instances, count(*) AS unique_keys, min(rn) FILTER (WHERE run * 2 >= total) AS keys_for_half,
  round(max(total) / count(*), 4) AS reuse FROM (SELECT row_number() OVER (ORDER BY n DESC, label_key) AS rn,
    sum(n) OVER (ORDER BY n DESC, label_key) AS run, sum(n) OVER () AS total FROM (SELECT label_key, count(*) AS n FROM {t} GROUP BY 1))"""


@query("reuse_curve", D.with_ctes(*_CORPUS) + _CURVE.format(t="qc"))
def reuse_curve(spark, d):
    return A.reuse_curve(D.questions(spark, d))


@query("reuse_curve_lines", D.with_ctes(D.TEXT_LINES, _LQ) + _CURVE.format(t="lq"))
def reuse_curve_lines(spark, d):
    return A.reuse_curve(D.text_lines(spark, d).withColumn("label_key", T.normalise_label("label")))


@query("status_counts", D.with_ctes(D.APPS) + """SELECT candidate_id, count(*) FILTER (WHERE status = 'SAVED') AS saved,
  count(*) FILTER (WHERE status = 'READY') AS ready, count(*) FILTER (WHERE status = 'APPLIED') AS applied,
  count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM apps GROUP BY 1""")
def status_counts(spark, d):
    return A.status_counts(K.application_state(D.app_events(spark, d)))


@query("skill_demand", D.with_ctes(D.POSTS) + """SELECT term, count(*) FILTER (WHERE r = 0) AS asked, count(*) FILTER (WHERE r = 1) AS required
  FROM (SELECT unnest(skills) AS term, 0 AS r FROM posts UNION ALL SELECT unnest(required_skills), 1 FROM posts) GROUP BY 1""")
def skill_demand(spark, d):
    return A.skill_demand(D.postings(spark, d))
