"""Question labels and options: T11-T19, J7."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia.functions import text as T
from vacantia.operators.planning import match_option

_KEYED = D.with_ctes(D.LINES, D.QUESTIONS_RAW, f"q AS (SELECT *, {Q.label_key('label')} AS label_key FROM qraw)")


@query("normalise_label_lines", D.with_ctes(D.TEXT_LINES) + f"""SELECT {Q.label_key('label')} AS label_key, count(*) AS n
  FROM tlines GROUP BY 1""")
def normalise_label_lines(spark, d):
    return D.text_lines(spark, d).groupBy(T.normalise_label("label").alias("label_key")).agg(F.count("*").alias("n"))


@query("normalise_label_questions", D.with_ctes(D.LINES, D.QUESTIONS_RAW)
       + f"SELECT posting_id, position::INTEGER AS position, {Q.label_key('label')} AS label_key FROM qraw")
def normalise_label_questions(spark, d):
    return D.questions(spark, d).select("posting_id", "position", "label_key")


@query("classify_question", _KEYED + f"""SELECT posting_id, position::INTEGER AS position, {Q.classify('label_key', 'kinds')}
  AS answerability FROM q""")
def classify_question(spark, d):
    return D.questions(spark, d).select("posting_id", "position", "answerability")


@query("field_kind", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'short_text' WHEN 'PROMO' THEN 'long_text' WHEN 'LARGE' THEN 'file'
  WHEN 'STANDARD' THEN 'single_select' WHEN 'MEDIUM' THEN 'multi_select' ELSE 'unknown' END AS kind FROM part""")
def field_kind(spark, d):
    names = {"ECONOMY": "input_text", "PROMO": "textarea", "LARGE": "input_file",
             "STANDARD": "multi_value_single_select", "MEDIUM": "multi_value_multi_select"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return D.read(spark, d, "part").select("p_partkey", T.field_kind(m[F.col("p_type")]).alias("kind"))


@query("human_only", _KEYED + f"""SELECT label_key, {Q.human_only('label_key')} AS human_only,
  {Q.has('label_key', Q.any_of(V.NO_AI_PATTERNS))} AS forbids_generated, count(*) AS n FROM q GROUP BY ALL""")
def human_only(spark, d):
    keys = D.questions(spark, d).groupBy("label_key").agg(F.count("*").alias("n"))
    return keys.select("label_key", T.human_only("label_key").alias("human_only"),
                       T.forbids_generated("label_key").alias("forbids_generated"), "n")


@query("profile_field_for", _KEYED + f"SELECT label_key, {Q.profile_field('label_key')} AS field, count(*) AS n FROM q GROUP BY ALL")
def profile_field_for(spark, d):
    keys = D.questions(spark, d).groupBy("label_key").agg(F.count("*").alias("n"))
    return keys.select("label_key", T.profile_field_for("label_key").alias("field"), "n")


VALUE_SQL = """CASE field WHEN 'first_name' THEN first_name WHEN 'last_name' THEN last_name WHEN 'email' THEN email
    WHEN 'phone' THEN phone WHEN 'location' THEN location WHEN 'country' THEN country WHEN 'linkedin' THEN linkedin
    WHEN 'current_title' THEN current_title WHEN 'full_name' THEN first_name || ' ' || last_name END"""


@query("resolve_profile_value", D.with_ctes(D.LINES, D.QUESTIONS_RAW, f"q AS (SELECT *, {Q.label_key('label')} AS label_key FROM qraw)",
                                            f"k AS (SELECT *, {Q.profile_field('label_key')} AS field FROM q)", D.CANDS_PLAIN)
       + f"SELECT posting_id, position::INTEGER AS position, field, {VALUE_SQL} AS value FROM k JOIN cands0 USING (candidate_id)")
def resolve_profile_value(spark, d):
    p = D.candidates(spark, d, with_skills=False)
    p = p.select("candidate_id", T.profile_values(p.columns).alias("v"))
    return D.questions(spark, d).join(p, "candidate_id").select(
        "posting_id", "position", T.profile_field_for("label_key").alias("field"),
        T.resolve_profile_value("label_key", "v").alias("value"))


_OPTIONS = ("opt AS (SELECT DISTINCT unnest(string_split(opts, '|')) AS label FROM qraw WHERE opts <> '' UNION "
            "SELECT DISTINCT p_name || ' (optional) of the ' || p_brand FROM part)")


@query("canon_option", D.with_ctes(D.LINES, D.QUESTIONS_RAW, _OPTIONS, f"c AS (SELECT label, {Q.canon('label')} AS canon FROM opt)")
       + f"SELECT label, canon, {Q.synonym('canon')} AS synonym FROM c")
def canon_option(spark, d):
    offered = D.questions(spark, d).select(F.explode("fields").alias("f")).select(
        F.explode("f.options").alias("o")).select(F.col("o.label").alias("label"))
    more = D.read(spark, d, "part").select(
        F.concat("p_name", F.lit(" (optional) of the "), "p_brand").alias("label"))
    return offered.unionByName(more).distinct().withColumn("canon", T.canon_option("label")).withColumn(
        "synonym", T.synonym_class("canon"))





@query("match_option", D.with_ctes(
    D.LINES, "rowq AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name, ['Company Website', 'LinkedIn', 'No', "
    "split_part(p_name, ' ', 1) || ' USER', p_brand || ' (the)', 'Female'] AS os, CASE WHEN l_returnflag = 'R' THEN ['yes', 'Referral'] "
    "WHEN l_returnflag = 'A' THEN ['the ' || p_brand, 'No'] WHEN l_linestatus = 'F' THEN ['n', 'LinkedIn'] "
    "ELSE ['linkedin.com', p_name] END AS ps FROM lines)",
    "dist AS (SELECT DISTINCT ps, os FROM rowq)",
    "e AS (SELECT ps, os, unnest(range(1, len(ps) + 1)) AS pn FROM dist), e2 AS (SELECT *, unnest(range(1, len(os) + 1)) AS ono FROM e)",
    f"c AS (SELECT *, ps[pn] AS p, os[ono] AS o, {Q.canon('ps[pn]')} AS pc, {Q.canon('os[ono]')} AS oc FROM e2)",
    f"v AS (SELECT *, CASE WHEN pc = '' THEN NULL WHEN o = p THEN 1 WHEN oc = pc THEN 2 WHEN {Q.synonym('oc')} = {Q.synonym('pc')} THEN 3 "
    "WHEN length(pc) >= 4 AND (contains(oc, pc) OR contains(pc, oc)) THEN 4 END AS via FROM c)",
    "b AS (SELECT ps, os, arg_min(o, (pn, via, ono)) FILTER (WHERE via IS NOT NULL) AS option, "
    "arg_min(via, (pn, via, ono)) FILTER (WHERE via IS NOT NULL) AS via FROM v GROUP BY 1, 2)")
    + """SELECT b.option, CASE b.via WHEN 1 THEN 'exact' WHEN 2 THEN 'canonical' WHEN 3 THEN 'synonym' WHEN 4 THEN 'substring' END AS via,
  count(*) AS n FROM rowq JOIN b ON rowq.ps = b.ps AND rowq.os = b.os GROUP BY ALL""")
def match_option_lines(spark, d):
    li = D.lines(spark, d)
    opts = F.transform(F.array(F.lit("Company Website"), F.lit("LinkedIn"), F.lit("No"),
                               F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" USER")),
                               F.concat("p_brand", F.lit(" (the)")), F.lit("Female")),
                       lambda x: F.struct(x.alias("label"), x.alias("value")))
    prefs = (F.when(F.col("l_returnflag") == "R", F.array(F.lit("yes"), F.lit("Referral")))
             .when(F.col("l_returnflag") == "A", F.array(F.concat(F.lit("the "), "p_brand"), F.lit("No")))
             .when(F.col("l_linestatus") == "F", F.array(F.lit("n"), F.lit("LinkedIn")))
             .otherwise(F.array(F.lit("linkedin.com"), F.col("p_name"))))
    # Equal inputs are matched once.
    once = li.groupBy(prefs.alias("ps"), opts.alias("os")).agg(F.count("*").alias("n"))
    return (once.withColumn("m", match_option("ps", "os")).groupBy(
        F.col("m.label").alias("option"), F.col("m.via").alias("via")).agg(F.sum("n").alias("n")))
