"""Joins: J1-J4, J6, J8-J12 (J5 is in scoring, J7 in labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.maintenance import _VARIANTS, _resume_files, _variant_events, _variants
from vacantia.catalog.registry import query
from vacantia.operators import planning as P
from vacantia.operators import stats as A
from vacantia.operators import tracking as K
from vacantia.session import materialise


@query("with_board", D.with_ctes(D.POSTS_PLAIN, D.BOARDS) + "SELECT posting_id, last_fetched_at FROM posts JOIN boards USING (board) WHERE NOT disabled")
def with_board(spark, d):
    return K.with_board(D.postings(spark, d, with_skills=False), D.boards(spark, d)).select("posting_id", "last_fetched_at")


@query("with_question_count", D.with_ctes(D.POSTS_PLAIN) + """SELECT posting_id, CASE WHEN form_fetched_at IS NOT NULL THEN coalesce(n, 0) END AS question_count
  FROM posts LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey::VARCHAR = external_id""")
def with_question_count(spark, d):
    q = D.questions(spark, d)
    return K.with_question_count(D.postings(spark, d, with_skills=False), q).select("posting_id", "question_count")


def _apps(spark, d):
    return K.application_state(D.app_events(spark, d))


def _numbered(spark, d):
    return D.postings(spark, d, with_skills=False).withColumn("posting_id", F.col("external_id"))


@query("application_view", D.with_ctes(D.APPS, D.POSTS_PLAIN) + """SELECT candidate_id, external_id AS posting_id, status, title, sent_at
  FROM apps JOIN posts ON apps.posting_id = external_id""")
def application_view(spark, d):
    a = _apps(spark, d)
    sent = a.where(F.col("sent_at").isNotNull()).select("candidate_id", "posting_id", "sent_at")
    return K.application_view(a.drop("sent_at"), _numbered(spark, d), sent).select(
        "candidate_id", "posting_id", "status", "title", "sent_at")


@query("bank_matches", D.with_ctes(D.LINES, D.QUESTIONS_RAW, f"q AS (SELECT DISTINCT candidate_id, {Q.label_key('label')} AS label_key FROM qraw)")
       + """SELECT candidate_id, label_key, CASE WHEN label_key IN ('how did you hear about this job', 'are you legally authorized to work in the country')
   OR (label_key = 'notice period' AND c_acctbal >= 0) THEN 'exact' ELSE 'pattern' END AS via,
  CASE WHEN label_key = 'how did you hear about this job' THEN 0 WHEN contains(label_key, 'sponsor') OR contains(label_key, 'authorized to work') THEN 1
   WHEN label_key LIKE 'notice%' AND c_acctbal >= 0 THEN 2 ELSE 3 END AS ord FROM q JOIN customer ON candidate_id = c_custkey
  WHERE label_key = 'how did you hear about this job' OR contains(label_key, 'sponsor') OR contains(label_key, 'authorized to work')
   OR (label_key LIKE 'notice%' AND c_acctbal >= 0) OR contains(label_key, 'have you worked with')""")
def bank_matches(spark, d):
    return A.bank_matches(D.questions(spark, d), D.bank(spark, d)).select("candidate_id", "label_key", "via", "ord")


def _keys_and_patterns(spark, d):
    """Names of parts as keys; a pattern for every part: two of its words, apart or either of them, or a form of its type."""
    p = D.read(spark, d, "part")
    keys = p.select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"), F.col("p_partkey").cast("string")).alias("label_key"))
    name, n = F.split(F.lower("p_name"), " "), F.col("p_partkey").cast("string")
    made = F.when(F.col("p_partkey") % 4 == 0, F.concat(name[0], F.lit(".*"), n, F.lit("$"))).when(
        F.col("p_partkey") % 4 == 1, F.concat(F.lit("("), name[0], F.lit("|^"), name[1], F.lit(r") [a-z]+ \b"), n)).when(
        F.col("p_partkey") % 4 == 2, F.concat(F.lit(r"\d{2}"), n, F.lit("?$"))).otherwise(F.concat(F.lit("(?:x+|"), name[1], F.lit(")+ "), F.lower("p_type"), F.lit(r"\s(?:"), n, F.lit("|0)")))
    return keys, p.select(made.alias("p"))


_KEYS = r"""ks AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) || ' ' || p_partkey AS label_key FROM part),
  ps AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN split_part(lower(p_name), ' ', 1) || '.*' || p_partkey || '$'
    WHEN 1 THEN '(' || split_part(lower(p_name), ' ', 1) || '|^' || split_part(lower(p_name), ' ', 2) || ') [a-z]+ \b' || p_partkey
    WHEN 2 THEN '\d{2}' || p_partkey || '?$' ELSE '(?:x+|' || split_part(lower(p_name), ' ', 2) || ')+ ' || lower(p_type) || '\s(?:' || p_partkey || '|0)' END AS p FROM part)""".replace("\\\\", "\\")


# The check tries every pattern on every key.
@query("pattern_hits", D.with_ctes(_KEYS) + "SELECT label_key, p FROM ks JOIN ps ON regexp_matches(label_key, p)")
def pattern_hits(spark, d):
    return A.pattern_hits(*_keys_and_patterns(spark, d))


@query("pattern_survivors", D.with_ctes(_KEYS) + """SELECT label_key, count(p) AS matched, true AS few FROM ks LEFT JOIN ps ON regexp_matches(label_key, p) GROUP BY 1""")
def pattern_survivors(spark, d):
    """``few``: no key is tried with more than a tenth of all patterns and ten."""
    keys, patterns = _keys_and_patterns(spark, d)
    most = patterns.distinct().agg(F.count("*")).scalar() / 10 + 10
    return A.pattern_survivors(keys, patterns).select("label_key", "matched", (F.col("tried") <= most).alias("few"))


@query("screen_patterns", """SELECT c_custkey AS candidate_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS kept FROM customer""")
def screen_patterns(spark, d):
    c = D.read(spark, d, "customer")
    bad = F.when(F.col("c_acctbal") < 0, F.lit("([")).otherwise(F.concat(F.lit("^x"), F.col("c_nationkey").cast("string")))
    b = c.select(F.col("c_custkey").alias("candidate_id"), F.lit(0).alias("ord"),
                 F.array(F.lit("sponsor"), bad).alias("label_patterns"))
    return A.screen_patterns(b).select("candidate_id", F.size("label_patterns").alias("kept"))


# ---------------------------------------------------------------- J8: order lines as plan actions and as page fields
_EL = """el AS (SELECT l_orderkey AS form_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(D.LINE_ORDER) + """) AS ord,
    p_name, p_brand, p_size, l_returnflag, l_linestatus, l_quantity::INTEGER AS qty FROM lines),
  act AS (SELECT form_id, ord, 'f_' || p_size AS field_name, p_name || ' *' AS label, CASE l_returnflag WHEN 'R' THEN 'user' ELSE 'profile' END AS source,
    CASE WHEN qty > 5 THEN p_brand END AS value FROM el),
  fld AS (SELECT form_id, ord, 'h' || ord AS handle, CASE WHEN l_linestatus = 'F' THEN 'f_' || p_size END AS name,
    CASE WHEN l_linestatus = 'O' AND qty > 25 THEN 'f_' || p_size END AS id, CASE WHEN qty > 45 THEN 'Extra ' || ord ELSE upper(p_name) || ' (required)' END AS label,
    CASE WHEN qty > 40 THEN 'select' ELSE 'text' END AS kind, ['Brand#1', lower(p_brand) || '*'] AS options FROM el)"""


def _elements(spark, d):
    e = materialise(D.numbered(spark, d, "p_name", "p_brand", "p_size", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("qty"))
                    .withColumnRenamed("line", "ord"))  # read by every join of the match
    fname = F.concat(F.lit("f_"), F.col("p_size").cast("string"))
    form = F.col("l_orderkey").alias("form_id")
    act = e.select(form, "ord", fname.alias("field_name"), F.concat("p_name", F.lit(" *")).alias("label"),
                   F.when(F.col("l_returnflag") == "R", "user").otherwise("profile").alias("source"),
                   F.when(F.col("qty") > 5, F.col("p_brand")).alias("value"), F.lit(True).alias("required"))
    fld = e.select(form, "ord", F.concat(F.lit("h"), F.col("ord").cast("string")).alias("handle"),
                   F.when(F.col("l_linestatus") == "F", fname).alias("name"),
                   F.when((F.col("l_linestatus") == "O") & (F.col("qty") > 25), fname).alias("id"),
                   F.when(F.col("qty") > 45, F.concat(F.lit("Extra "), F.col("ord").cast("string"))).otherwise(
                       F.concat(F.upper("p_name"), F.lit(" (required)"))).alias("label"),
                   F.when(F.col("qty") > 40, "select").otherwise("text").alias("kind"),
                   F.array(F.lit("Brand#1"), F.concat(F.lower("p_brand"), F.lit("*"))).alias("options"))
    return act, fld


_J8 = D.with_ctes(
    D.LINES, _EL,
    "n AS (SELECT form_id, name AS k, max(ord) AS o FROM fld WHERE name IS NOT NULL GROUP BY 1, 2)",
    "i AS (SELECT form_id, id AS k, max(ord) AS o FROM fld WHERE id IS NOT NULL GROUP BY 1, 2)",
    "l AS (SELECT form_id, trim(replace(lower(label), '(required)', '')) AS k, max(ord) AS o FROM fld GROUP BY 1, 2)",
    """m AS (SELECT a.*, coalesce(n.o, i.o, l.o) AS fo, CASE WHEN n.o IS NOT NULL THEN 'name' WHEN i.o IS NOT NULL THEN 'id' WHEN l.o IS NOT NULL THEN 'label' END AS via
    FROM act a LEFT JOIN n ON n.form_id = a.form_id AND n.k = field_name LEFT JOIN i ON i.form_id = a.form_id AND i.k = field_name
    LEFT JOIN l ON l.form_id = a.form_id AND l.k = trim(replace(lower(a.label), '*', '')))""",
    """j AS (SELECT m.*, f.handle, f.kind, CASE WHEN f.kind = 'select' THEN list_filter(f.options, lambda o:
      replace(replace(lower(o), '*', ''), '#', '') = replace(lower(m.value), '#', ''))[1] END AS opt,
    source = 'user' OR value IS NULL AS skip FROM m LEFT JOIN fld f ON f.form_id = m.form_id AND f.ord = fo)""",
    "u AS (SELECT *, NOT skip AND fo IS NOT NULL AND (kind <> 'select' OR opt IS NOT NULL) AS can FROM j)",
    "w AS (SELECT *, min(ord) FILTER (WHERE can) OVER (PARTITION BY form_id, fo) AS first FROM u)",
    """r AS (SELECT *, CASE WHEN skip THEN 'skipped' WHEN fo IS NULL OR first < ord THEN 'unmatched' WHEN can THEN 'fill' ELSE 'skipped' END AS outcome FROM w)""")


@query("match_plan_to_page", _J8 + """SELECT form_id, ord::INTEGER AS ord, outcome, CASE WHEN outcome = 'fill' THEN handle END AS handle,
  CASE WHEN outcome = 'fill' THEN coalesce(opt, value) END AS value, CASE WHEN outcome = 'fill' THEN via END AS via FROM r""")
def match_plan_to_page(spark, d):
    return P.match_plan_to_page(*_elements(spark, d))[0].select("form_id", "ord", "outcome", "handle", "value", "via")


@query("unplanned_page_fields", _J8 + """SELECT f.form_id, f.handle, f.label, f.kind FROM fld f
  LEFT JOIN (SELECT form_id, handle FROM r WHERE outcome = 'fill') x ON x.form_id = f.form_id AND x.handle = f.handle
  LEFT JOIN (SELECT DISTINCT form_id, trim(replace(lower(label), '*', '')) AS k FROM act) y ON y.form_id = f.form_id AND y.k = trim(replace(lower(f.label), '(required)', ''))
  WHERE x.handle IS NULL AND y.k IS NULL""")
def unplanned_page_fields(spark, d):
    return P.match_plan_to_page(*_elements(spark, d))[1].select("form_id", "handle", "label", "kind")


# ---------------------------------------------------------------- J9, J11, J12
@query("effective_profile", D.with_ctes(D.CANDS_PLAIN, _VARIANTS) + """SELECT c.candidate_id, coalesce(v.current_title, c.current_title) AS current_title,
  CASE WHEN v.has_skill THEN 'a b' ELSE 'base' END AS skills, f.resume_name FROM cands0 c LEFT JOIN vsel v ON v.candidate_id = c.candidate_id AND v.active
  LEFT JOIN (SELECT o_custkey, arg_max('r' || o_orderkey || '.pdf', (o_orderdate, 'r' || o_orderkey || '.pdf')) AS resume_name FROM orders
    WHERE o_orderstatus = 'F' GROUP BY 1) f ON o_custkey = c.candidate_id""")
def effective_profile(spark, d):
    p = D.candidates(spark, d, with_skills=False).drop("resume_name").withColumn("skills", F.array(F.lit("base")))
    v = K.select_variant(_variants(spark, d), _variant_events(spark, d))
    return K.effective_profile(p, v, _resume_files(spark, d)).select(
        "candidate_id", "current_title", F.array_join("skills", ",").alias("skills"), "resume_name")


@query("fetch_in_order", D.with_ctes(D.POSTS_PLAIN) + """SELECT years_required + o_custkey AS rank, posting_id, title FROM posts JOIN orders ON o_orderkey::VARCHAR = external_id
  WHERE years_required IS NOT NULL""")
def fetch_in_order(spark, d):
    p = D.postings(spark, d, with_skills=False)
    ids = p.where(F.col("years_required").isNotNull()).select("posting_id", (F.col("years_required") + F.col("owner_id")).alias("rank"))
    return K.fetch_in_order(ids, p.select("posting_id", "title")).select("rank", "posting_id", "title")


@query("current_company", D.with_ctes(D.LINES, D.BULLETS, D.ROLES) + """SELECT candidate_id, CASE WHEN count(*) FILTER (WHERE "end" IS NULL) = 1
  THEN max(company) FILTER (WHERE "end" IS NULL) END AS current_company FROM roles GROUP BY 1""")
def current_company(spark, d):
    return D.experience(spark, d).select("candidate_id", K.current_company("experience").alias("current_company"))
