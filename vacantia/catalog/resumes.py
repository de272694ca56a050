"""Resume text: R1-R7 over documents and over resumes written from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia.functions import text as T
from vacantia.operators import resume as R

VOCAB = ("red widget", "widget", "bolt", "ring", "gear")


def _cv(spark, d):
    """A resume per customer: head lines, skills from part names, a role per order with its lines."""
    o = D.read(spark, d, "orders")
    li = D.lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("• Sold "), "p_name"))).alias("b"))
    role = F.concat(
        F.lit("Clerk, Shop "), F.col("o_orderkey").cast("string"), F.lit(" Ltd"),
        F.when(F.col("o_orderstatus") == "O", " — Pune").otherwise(""),
        F.lit("\n"), F.date_format("o_orderdate", "yyyy"), F.when(F.col("o_orderstatus") == "F", " - 2002").when(
            F.col("o_orderstatus") == "P", " to present").otherwise(" and on"), F.lit("\n"),
        F.coalesce(F.array_join("b", "\n"), F.lit("")))
    roles = (o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", role.alias("t")))), lambda x: x["t"]), "\n").alias("roles")))
    c = D.candidates(spark, d, with_skills=False)
    head = F.concat_ws("\n", F.concat("first_name", F.lit(" Person")), F.concat_ws(
        " - ", F.when(F.col("email").isNotNull(), "person@example.com"), F.when(F.col("phone").isNotNull(), F.lit("+91 98290 41765")), F.lit("Jodhpur, Rajasthan, India")),
        F.coalesce("current_title", F.lit("Shop clerk")), F.lit("EXPERIENCE"))
    return (c.join(roles, c.candidate_id == roles.o_custkey, "left").select(
        F.col("candidate_id").alias("doc_id"), F.concat_ws(
            "\n", head, F.coalesce("roles", F.lit("")), F.lit("Skills\nRed Widget, bolt; Juggling | x"), F.lit("Date of birth: 1 May 1980"),
            F.lit("Education\nSchool of Trade")).alias("text")))


@query("contacts_documents", f"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, {Q.lit('[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+[.][0-9A-Za-z_.-]+')})))::INTEGER AS n_emails,
  coalesce(list_distinct(regexp_extract_all(text, {Q.lit('[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+[.][0-9A-Za-z_.-]+')}))[1] IS NOT NULL, false) AS has_email,
  array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, {Q.lit(V.PHONE)}), lambda p: {Q.trim('p')})),
    lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND NOT {Q.has('p', V.YEAR_RANGE)})), '|') AS phones FROM documents""")
def contacts_documents(spark, d):
    docs = D.read(spark, d, "documents").withColumn("e", R.emails("text"))
    return docs.select("doc_id", F.size("e").alias("n_emails"), (F.size("e") > 0).alias("has_email"),
                       F.array_join(F.array_sort(R.phones("text")), "|").alias("phones"))


@query("contacts", D.with_ctes(D.CANDS_PLAIN) + """SELECT candidate_id AS doc_id, CASE WHEN email IS NULL THEN '' ELSE 'person@example.com' END AS email, CASE WHEN email IS NULL THEN 'low' ELSE 'high' END AS email_confidence,
  CASE WHEN phone IS NULL THEN '' ELSE '+91 98290 41765' END AS phone, '' AS link FROM cands0""")
def contacts(spark, d):
    return _cv(spark, d).withColumn("c", R.contacts("text")).select(
        "doc_id", F.col("c.email.value").alias("email"), F.col("c.email.confidence").alias("email_confidence"),
        F.col("c.phone.value").alias("phone"), F.col("c.link.value").alias("link"))


@query("name_title_location", D.with_ctes(D.CANDS_PLAIN) + """SELECT candidate_id AS doc_id, 'Customer' AS first_name, 'Person' AS last_name,
  coalesce(current_title, 'Shop clerk') AS title, 'Jodhpur, Rajasthan, India' AS location FROM cands0""")
def name_title_location(spark, d):
    cv = _cv(spark, d).withColumn("l", R.resume_lines("text")).withColumn("w", R.name_title_location("l"))
    return cv.select("doc_id", "w.first_name", "w.last_name", "w.title", "w.location")


@query("resume_sections", """SELECT c_custkey AS doc_id, 2 AS n_skill_lines, coalesce(n, 0)::INTEGER AS n_experience_lines FROM customer LEFT JOIN (
  SELECT o_custkey, sum(2 + coalesce(k, 0)) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)
  ON o_custkey = c_custkey""")
def resume_sections(spark, d):
    """The birth date line ends up in the skills block, which is what the rule says."""
    cv = _cv(spark, d).withColumn("l", R.resume_lines("text")).withColumn("s", R.sections("l"))
    return cv.select("doc_id", F.size("s.skills").alias("n_skill_lines"), F.size("s.experience").alias("n_experience_lines"))


@query("skills_block", """SELECT c_custkey AS doc_id, 'red widget=high,bolt=high,juggling=low,x date of birth: 1 may 1980=low' AS skills FROM customer""")
def skills_block(spark, d):
    cv = _cv(spark, d).withColumn("l", R.resume_lines("text")).withColumn("s", R.sections("l"))
    return cv.select("doc_id", F.array_join(F.transform(R.skills_block(F.col("s.skills"), VOCAB), lambda x: F.concat(
        x["value"], F.lit("="), x["confidence"])), ",").alias("skills"))


@query("resume_roles", """SELECT o_custkey AS doc_id, 'Clerk' AS title, 'Shop ' || o_orderkey || ' Ltd' AS company, CASE WHEN o_orderstatus = 'O' THEN 'Pune' END AS location,
  CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y') END AS start, CASE WHEN o_orderstatus = 'F' THEN '2002' END AS "end",
  coalesce(n, 0)::INTEGER AS n_bullets FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def resume_roles(spark, d):
    cv = _cv(spark, d).withColumn("s", R.sections(R.resume_lines("text")))
    return cv.select("doc_id", F.explode(R.roles(F.col("s.experience"))).alias("r")).select(
        "doc_id", "r.title", "r.company", "r.location", "r.start", "r.end", F.size("r.bullets").alias("n_bullets"))


@query("excluded_sensitive", "SELECT c_custkey AS doc_id, 'date of birth' AS excluded FROM customer")
def excluded_sensitive(spark, d):
    return _cv(spark, d).select("doc_id", F.array_join(R.excluded_sensitive("text"), ",").alias("excluded"))


@query("review_counts", """SELECT c_custkey AS doc_id, (7 + 4 + 4 * coalesce(r, 0) + coalesce(b, 0))::INTEGER AS field_count,
  (4 + CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END + CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 0 ELSE 1 END + 1 + 2 + 2 * coalesce(r, 0) + 2 * coalesce(u, 0))::INTEGER AS needs_review,
  CASE WHEN coalesce(r, 0) = 0 THEN 'no roles found' ELSE '' END AS warnings FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS r, count(*) FILTER (WHERE o_orderstatus = 'O') AS u, sum(n) AS b FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""")
def review_counts(spark, d):
    p = R.review_counts(R.parse_resumes(_cv(spark, d), VOCAB))
    return p.select("doc_id", "field_count", "needs_review", F.array_join("warnings", ",").alias("warnings"))


@query("parse_resumes_documents")
def parse_resumes_documents(spark, d):
    """Every document as a resume, whole texts: what was found, per language."""
    p = R.review_counts(R.parse_resumes(D.read(spark, d, "documents"), VOCAB))
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("contacts.email.value") != "").alias("emails"),
                                 F.sum("needs_review").alias("needs_review"), F.sum(F.size("excluded")).alias("excluded"))
