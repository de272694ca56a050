"""Postings, candidates, questions and the like, derived from the given tables.

Each table has a Spark builder and the SQL text of the same table for the check
queries.  All of them read whole tables, so their size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.session import expect_compressed, materialise

NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def ts(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def now() -> Column:
    return ts(NOW)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    expect_compressed(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ order lines
def lines(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    li = read(spark, d, "lineitem")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .withColumn("skill", F.concat(F.lower("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))))


LINES = """lines AS (SELECT *, lower(p_name) || ' ' || p_partkey AS skill
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus")

#: The first of these settle nearly every place; the others are many bytes a line.
_FIRST, _REST = LINE_ORDER[:2], LINE_ORDER[2:]


def numbered(spark: SparkSession, d: str, *kept: str | Column, orders: DataFrame | None = None) -> DataFrame:
    """Order lines with their parts (and orders): ``l_orderkey``, the columns ``kept`` and ``line``, the line's number in LINE_ORDER.

    A line takes the columns of LINE_ORDER beyond the first two through the shuffles only where another line may be equal in these.
    """
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    li = read(spark, d, "lineitem").withColumn("_key", F.xxhash64("l_orderkey", *_FIRST))
    equal = materialise(li.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key", F.lit(True).alias("_equal")))
    li = li.join(equal, "_key", "left").withColumn("_rest", F.when(F.col("_equal"), F.struct(*_REST)))
    li = li.join(part, li.l_partkey == part.p_partkey)
    if orders is not None:
        li = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("l_orderkey").orderBy(*_FIRST, "_rest")
    return li.select("l_orderkey", *kept, F.row_number().over(w).alias("line"))


# ------------------------------------------------------------------ postings
_SQL_LOC = """CASE WHEN c_acctbal < 0 THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED'
    THEN 'Remote - ' || n_name ELSE n_name || ' City, ' || n_name END"""


def postings(spark: SparkSession, d: str, with_skills: bool = True) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    base = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))
    if with_skills:
        ask = lines(spark, d).groupBy("l_orderkey").agg(
            F.array_sort(F.collect_set("skill")).alias("skills"),
            F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("skill"))))
            .alias("required_skills"), F.min("p_name").alias("head"))
        base = base.join(ask, base.o_orderkey == ask.l_orderkey, "left")
    else:
        base = base.withColumn("head", F.lit(None).cast("string"))
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    remote = pr.isin("1-URGENT", "4-NOT SPECIFIED")
    none = F.array().cast("array<string>")
    day = F.expr("interval 1 day")
    cols = [
        F.concat_ws(":", F.lit("orders"), pr, F.col("o_orderkey").cast("string")).alias("posting_id"),
        F.lit("orders").alias("vendor"), pr.alias("board"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat_ws(" ", F.when(st == "O", "Senior").when(st == "F", "Junior"), "c_mktsegment", "head")
        .alias("title"),
        F.col("c_name").alias("company"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
        .when(pr == "4-NOT SPECIFIED", F.concat(F.lit("Remote - "), "n_name"))
        .otherwise(F.concat("n_name", F.lit(" City, "), "n_name")).alias("location"),
        F.when(pr != "5-LOW", F.col("n_name")).alias("country"),
        remote.alias("remote"),
        F.when(remote & (st == "P"), F.col("r_name")).alias("remote_scope"),
        F.when(remote, "remote").when(pr == "2-HIGH", "hybrid").when(pr == "3-MEDIUM", "onsite")
        .alias("workplace"),
        F.when(st == "O", "senior").when(st == "F", "junior").alias("level"),
        F.when(st != "P", F.floor(F.col("o_totalprice") / 50000).cast("int")).alias("years_required"),
        F.col("o_orderdate").alias("posted_at"), F.col("o_orderdate").alias("first_seen_at"),
        (F.col("o_orderdate") + day).alias("fetched_at"),
        F.when(F.col("o_orderdate") < ts("1996-01-01 00:00:00"),
               F.col("o_orderdate") + F.expr("interval 90 days")).alias("closed_at"),
        F.when(pr != "5-LOW", F.col("o_orderdate") + day).alias("form_fetched_at"),
        (F.col("o_totalprice") > 100000).alias("form_readable"),
    ]
    if with_skills:
        cols += [F.coalesce("skills", none).alias("skills"),
                 F.coalesce("required_skills", none).alias("required_skills")]
    return base.select(*cols)


ASK = """ask AS (SELECT l_orderkey, list_sort(list(DISTINCT skill)) AS skills,
    list_sort(coalesce(list(DISTINCT skill) FILTER (WHERE l_returnflag = 'R'), []::VARCHAR[])) AS required_skills,
    min(p_name) AS head FROM lines GROUP BY 1)"""

_POSTS = """posts AS (SELECT 'orders:' || o_orderpriority || ':' || o_orderkey AS posting_id,
    'orders' AS vendor, o_orderpriority AS board, o_orderkey::VARCHAR AS external_id, o_custkey AS owner_id,
    concat_ws(' ', CASE o_orderstatus WHEN 'O' THEN 'Senior' WHEN 'F' THEN 'Junior' END, c_mktsegment, head) AS title,
    c_name AS company, """ + _SQL_LOC + """ AS location,
    CASE WHEN o_orderpriority <> '5-LOW' THEN n_name END AS country,
    o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AS remote,
    CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AND o_orderstatus = 'P' THEN r_name END AS remote_scope,
    CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'remote' WHEN o_orderpriority = '2-HIGH' THEN 'hybrid'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'onsite' END AS workplace,
    CASE o_orderstatus WHEN 'O' THEN 'senior' WHEN 'F' THEN 'junior' END AS level,
    CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 50000)::INTEGER END AS years_required,
    o_orderdate AS posted_at, o_orderdate AS first_seen_at, o_orderdate + INTERVAL 1 DAY AS fetched_at,
    CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN o_orderdate + INTERVAL 90 DAY END AS closed_at,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 1 DAY END AS form_fetched_at,
    o_totalprice > 100000 AS form_readable%s
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey %s)"""
POSTS = ",\n".join([LINES, ASK, _POSTS % (
    ", coalesce(skills, []::VARCHAR[]) AS skills, coalesce(required_skills, []::VARCHAR[]) AS required_skills",
    "LEFT JOIN ask ON o_orderkey = l_orderkey")])
POSTS_PLAIN = _POSTS.replace("c_mktsegment, head", "c_mktsegment") % ("", "")


def boards(spark: SparkSession, d: str) -> DataFrame:
    """One board per order priority; one of them is disabled."""
    o = read(spark, d, "orders")
    b = o.groupBy(F.col("o_orderpriority").alias("board")).agg(
        F.max("o_orderdate").alias("last_fetched_at"))
    return b.withColumn("disabled", F.col("board") == "3-MEDIUM")


BOARDS = """boards AS (SELECT o_orderpriority AS board, max(o_orderdate) AS last_fetched_at,
  o_orderpriority = '3-MEDIUM' AS disabled FROM orders GROUP BY 1)"""


# ------------------------------------------------------------------ candidates
def candidates(spark: SparkSession, d: str, with_skills: bool = True,
               with_experience: bool = False) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    bal, seg, name = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_name")
    out = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("candidate_id"), F.substring_index(name, "#", 1).alias("first_name"),
        F.substring_index(name, "#", -1).alias("last_name"),
        F.when(bal >= 0, F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com")))
        .alias("email"),
        F.when(seg != "HOUSEHOLD", F.concat(F.lit("+1 555 "), F.col("c_custkey").cast("string"))).alias("phone"),
        F.concat("n_name", F.lit(" City, "), "n_name").alias("location"),
        F.concat("n_name", F.lit(" City")).alias("city"), F.lit(None).cast("string").alias("state"),
        F.when(bal <= 9000, F.col("n_name")).alias("country"),
        F.when(bal > 5000, F.concat(F.lit("https://linkedin.com/in/c"), F.col("c_custkey").cast("string")))
        .alias("linkedin"),
        F.when(bal > 8000, F.lit(None).cast("string")).when(bal > 5000, F.concat(F.lit("Senior "), seg))
        .when(bal < 2000, F.concat(F.lit("Junior "), seg)).otherwise(seg).alias("current_title"),
        F.when(bal <= 7000, F.col("c_nationkey")).alias("years_experience"),
        F.when(bal >= 0, F.concat(F.lit("resume-"), F.col("c_custkey").cast("string"), F.lit(".pdf")))
        .alias("resume_name"),
        F.lower("n_name").alias("candidate_country"))
    if with_skills:
        o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
        mine = (lines(spark, d).where(F.col("l_linestatus") == "O")
                .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy("o_custkey").agg(F.array_sort(F.collect_set("skill")).alias("skills")))
        out = (out.join(mine, out.candidate_id == mine.o_custkey, "left").drop("o_custkey")
               .withColumn("skills", F.coalesce("skills", F.array().cast("array<string>"))))
    if with_experience:
        out = out.join(experience(spark, d), "candidate_id", "left")
    return out


CANDS_PLAIN = """cands0 AS (SELECT c_custkey AS candidate_id, split_part(c_name, '#', 1) AS first_name,
    split_part(c_name, '#', 2) AS last_name,
    CASE WHEN c_acctbal >= 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN '+1 555 ' || c_custkey END AS phone,
    n_name || ' City, ' || n_name AS location, n_name || ' City' AS city, NULL::VARCHAR AS state,
    CASE WHEN c_acctbal <= 9000 THEN n_name END AS country,
    CASE WHEN c_acctbal > 5000 THEN 'https://linkedin.com/in/c' || c_custkey END AS linkedin,
    CASE WHEN c_acctbal > 8000 THEN NULL WHEN c_acctbal > 5000 THEN 'Senior ' || c_mktsegment
         WHEN c_acctbal < 2000 THEN 'Junior ' || c_mktsegment ELSE c_mktsegment END AS current_title,
    CASE WHEN c_acctbal <= 7000 THEN c_nationkey END AS years_experience,
    CASE WHEN c_acctbal >= 0 THEN 'resume-' || c_custkey || '.pdf' END AS resume_name,
    lower(n_name) AS candidate_country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
CANDS = CANDS_PLAIN + """,
mine AS (SELECT o_custkey, list_sort(list(DISTINCT skill)) AS skills FROM lines JOIN orders ON l_orderkey = o_orderkey
  WHERE l_linestatus = 'O' GROUP BY 1),
cands AS (SELECT cands0.*, coalesce(mine.skills, []::VARCHAR[]) AS skills FROM cands0 LEFT JOIN mine ON candidate_id = o_custkey)"""


def bullets(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lines: one per order line; an order status is a role."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    text = F.concat(
        F.when(F.col("l_returnflag") == "R", "Responsible for ").when(F.col("l_returnflag") == "A", "Led ")
        .otherwise("Shipped "),
        F.when(F.col("l_linestatus") == "F", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" units of ")))
        .otherwise("many units of "), "p_name")
    return (lines(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderstatus").alias("role_no"),
                    "o_orderkey", "o_orderdate", "l_orderkey", "p_name", "skill", *LINE_ORDER, text.alias("text")))


BULLETS = """bullets AS (SELECT o_custkey AS candidate_id, o_orderstatus AS role_no, o_orderkey, o_orderdate, lines.*,
    CASE l_returnflag WHEN 'R' THEN 'Responsible for ' WHEN 'A' THEN 'Led ' ELSE 'Shipped ' END ||
    CASE WHEN l_linestatus = 'F' THEN l_quantity::INTEGER || ' units of ' ELSE 'many units of ' END || p_name AS text
  FROM lines JOIN orders ON l_orderkey = o_orderkey)"""


def experience(spark: SparkSession, d: str) -> DataFrame:
    role = bullets(spark, d).groupBy("candidate_id", "role_no").agg(
        F.array_sort(F.collect_list("text")).alias("bullets"),
        F.date_format(F.min("o_orderdate"), "yyyy").alias("start"))
    s = F.struct(
        F.col("role_no").alias("title"),
        F.when(F.col("role_no") != "P", F.concat(F.lit("Company "), "role_no")).alias("company"),
        F.when(F.col("start") != "1997", F.col("start")).alias("start"),
        F.when(F.col("role_no") != "O", "2001").alias("end"), F.lit(None).cast("string").alias("location"),
        "bullets")
    return role.groupBy("candidate_id").agg(F.array_sort(F.collect_list(s)).alias("experience"))


ROLES = """roles AS (SELECT candidate_id, role_no AS title, CASE WHEN role_no <> 'P' THEN 'Company ' || role_no END AS company,
    nullif(strftime(min(o_orderdate), '%Y'), '1997') AS start, CASE WHEN role_no <> 'O' THEN '2001' END AS "end",
    list_sort(list(text)) AS bullets FROM bullets GROUP BY candidate_id, role_no)"""

# ------------------------------------------------------------------ form questions
# label head, what follows it, field name, kinds, options
TEMPLATES = (
    ("First Name (required)", "", "first_name", "short_text", ""),
    ("Email *", "", "email", "short_text", ""),
    ("LinkedIn Profile", "", "q_link", "short_text", ""),
    ("Resume/CV", "", "resume", "file", ""),
    ("Cover Letter", "", "cover", "file+long_text", ""),
    ("Will you now or in the future require visa sponsorship?", "", "q_visa", "single_select", "Yes|No"),
    ("Are you legally authorized to work in the country? [US]", "", "q_auth", "single_select", "Yes, I am|No, I am not"),
    ("Why do you want to join ", "p_brand", "q_why", "long_text", ""),
    ("How did you hear about this job?", "", "q_hear", "single_select", "Company Website|LinkedIn|Referral"),
    ("Gender", "", "q_gender", "single_select", "Female|Male|Other"),
    ("I agree to the privacy policy", "", "q_privacy", "single_select", "I agree"),
    ("Please tell us about your work with a ", "p_name", "q_tell", "long_text", ""),
    ("What accommodations do you need?", "", "q_acc", "short_text", ""),
    ("Country", "", "country", "single_select", "NATION_1|NATION_2|NATION_3"),
    ("What is your current country of residence?", "", "q_res", "short_text", ""),
    ("If yes, please describe", "", "q_if", "short_text", ""),
    ("Address Line 2 (Optional)", "", "q_addr", "short_text", ""),
    ("Current company", "", "q_company", "short_text", ""),
    ("Humans only: say what you like in a ", "p_name", "q_human", "long_text", ""),
    ("Have you worked with a ", "p_name", "q_worked", "single_select", "Yes, often|No, never"),
    ("Phone &amp; mobile", "", "phone", "short_text", ""),
    ("Notice period for this role", "", "q_notice", "short_text", ""),
    ("Campaign", "", "job_application[utm_source]", "unknown", ""),
    ("Preferred pronouns", "", "q_pron", "single_select", "she/her|he/him|they/them"),
    ("Full name", "", "full_name", "short_text", ""),
    ("Notice period", "", "q_notice2", "short_text", ""),
)


def _asked(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Order lines with the template ``t`` that the part's size picks, and the wording it gives them."""
    heads = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in
                                 zip(("head", "tail", "name", "kinds", "options"), t)]) for t in TEMPLATES])
    li = lines.withColumn("t", F.element_at(heads, (F.col("p_size") % len(TEMPLATES) + 1).cast("int")))
    return li, F.concat(F.col("t.head"), F.when(F.col("t.tail") == "p_brand", F.col("p_brand"))
                        .when(F.col("t.tail") == "p_name", F.col("p_name")).otherwise(""))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per order line; the part's size picks the wording."""
    from vacantia.operators.planning import label_questions

    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li, label = _asked(numbered(spark, d, "l_returnflag", "p_size", "p_name", "p_brand", "o_orderkey", "o_custkey", "o_orderpriority", orders=o))
    opts = F.when(F.col("t.options") != "", F.transform(
        F.split(F.col("t.options"), r"\|"), lambda x: F.struct(x.alias("label"), F.lower(x).alias("value"))))
    return label_questions(materialise(li.select(
        F.col("o_custkey").alias("candidate_id"),
        F.concat_ws(":", F.lit("orders"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("posting_id"),
        (F.col("line") - 1).alias("position"),
        label.alias("label"),
        (F.col("l_returnflag") == "R").alias("required"),
        F.transform(F.split(F.col("t.kinds"), r"\+"), lambda k: F.struct(
            F.concat(F.col("t.name"), F.when(k == "long_text", "_text").otherwise("")).alias("name"),
            k.alias("kind"), opts.alias("options"))).alias("fields"))))


def question_wordings(spark: SparkSession, d: str) -> DataFrame:
    """The same questions with their wording, field kinds and ``required`` alone: what counts over the whole index read."""
    li, label = _asked(lines(spark, d))
    q = li.select("l_orderkey", label.alias("label"), F.replace(F.col("t.kinds"), F.lit("+"), F.lit(",")).alias("kinds"),
                  (F.col("l_returnflag") == "R").alias("required")).where("label IS NOT NULL")
    o = read(spark, d, "orders").select("o_orderkey")
    return q.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("label", "kinds", "required")


def _sql_str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QUESTIONS_RAW = ("tmpl(no, head, tail, fname, kinds, opts) AS (VALUES " + ", ".join(
    f"({i}, {', '.join(_sql_str(x) for x in t)})" for i, t in enumerate(TEMPLATES)) + """),
qraw AS (SELECT o_custkey AS candidate_id, 'orders:' || o_orderpriority || ':' || o_orderkey AS posting_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(LINE_ORDER) + """) - 1 AS position,
    head || CASE tail WHEN 'p_brand' THEN p_brand WHEN 'p_name' THEN p_name ELSE '' END AS label,
    l_returnflag = 'R' AS required, fname, kinds, opts
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN tmpl ON p_size % """ + str(len(TEMPLATES)) + """ = no)""")


# ------------------------------------------------------------------ saved answers
#: Patterns that do not compile, or that engines read differently: of no effect.
REFUSED = ("([", "(?P<n>notice)", r"\p{L}+", "(?i)SPONSOR", r"(a)\1", "notice++", "(?<=x)y")


def bank(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    e = "struct<ord:int,label_keys:array<string>,label_patterns:array<string>,text:string,option_preference:array<string>,sensitive:boolean,note:string>"

    def entry(i: int, keys: list[str], patterns: list[str], text: Column | None, prefs: list[str] | None,
              sensitive: bool, note: str | None) -> Column:
        arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        return F.struct(
            F.lit(i).alias("ord"), arr(keys).alias("label_keys"), arr(patterns).alias("label_patterns"),
            (text if text is not None else F.lit(None).cast("string")).alias("text"),
            (arr(prefs) if prefs else F.lit(None).cast("array<string>")).alias("option_preference"),
            F.lit(sensitive).alias("sensitive"), F.lit(note).cast("string").alias("note")).cast(e)

    rows = F.array(
        entry(0, ["how did you hear about this job"], [], None, ["LinkedIn job posting", "Job Board"], False, None),
        entry(1, ["are you legally authorized to work in the country"], ["sponsor", "authorized to work"], None,
              ["Yes"], True, None),
        F.when(F.col("c_acctbal") >= 0, entry(2, ["notice period"], ["^notice"],
                                              F.concat(F.length("c_mktsegment").cast("string"), F.lit(" weeks")),
                                              None, False, "Notice period")),
        entry(3, [], ["have you worked with", *REFUSED], None, ["Never", "no"], False, None))
    return (c.select(F.col("c_custkey").alias("candidate_id"), F.explode(rows).alias("e"))
            .where(F.col("e").isNotNull()).select("candidate_id", "e.*"))


# ------------------------------------------------------------------ application events
_STATUS = {"purchase": "APPLIED", "click": "SAVED", "view": "READY", "error": "SKIPPED"}


def app_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])
    return (e.where(F.col("event_type") != "signup").select(
        "event_id", "ts", F.col("user_id").alias("candidate_id"),
        F.get_json_object("props", "$.k").alias("posting_id"), status[F.col("event_type")].alias("status")))


APP_EVENTS = """app_events AS (SELECT event_id, ts, user_id AS candidate_id,
    json_extract_string(props, '$.k') AS posting_id,
    CASE event_type WHEN 'purchase' THEN 'APPLIED' WHEN 'click' THEN 'SAVED' WHEN 'view' THEN 'READY' ELSE 'SKIPPED' END AS status
  FROM events WHERE event_type <> 'signup')"""
APPS = APP_EVENTS + """,
apps AS (SELECT candidate_id, posting_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at,
    min(ts) AS created_at, min(ts) FILTER (WHERE status = 'APPLIED') AS sent_at
  FROM app_events GROUP BY 1, 2)"""


# ------------------------------------------------------------------ saved searches
def searches(spark: SparkSession, d: str) -> DataFrame:
    """One search per customer; its nation picks which parts are stated."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    p = read(spark, d, "part").select("p_partkey", "p_name")
    kind = F.col("c_nationkey") % 6
    name = F.lower("p_name")
    none = F.array().cast("array<string>")
    place = F.struct(F.col("n_name").alias("label"),
                     F.array(F.concat(F.lower("n_name"), F.lit(" city"))).alias("terms"))
    f = F.struct(
        F.when(kind == 3, F.col("c_name")).alias("company"),
        F.when(kind == 4, F.lit(30)).alias("days"),
        F.when(kind.isin(0, 5), F.when(F.col("c_acctbal") > 5000, "senior").otherwise("junior")).alias("level"),
        F.when(kind.isin(2, 5), place).alias("place"),
        F.when(kind == 1, F.array(F.concat(name, F.lit(" "), F.col("p_partkey").cast("string")))).otherwise(none)
        .alias("skills"),
        F.when(kind.isin(0, 4), F.split(name, " ")).when(kind == 2, F.slice(F.split(name, " "), 2, 1))
        .otherwise(none).alias("words"),
        F.when(kind == 2, "remote").when(kind == 5, "hybrid").alias("workplace"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(p, c.c_custkey == p.p_partkey).select(
        F.col("c_custkey").alias("search_id"), F.col("c_custkey").alias("candidate_id"),
        F.lower("n_name").alias("candidate_country"), F.concat(F.lit("search "), "c_name").alias("label"),
        f.alias("f"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
        ts("2000-01-01 00:00:00").alias("last_seen_at")))


SEARCHES = """srch AS (SELECT c_custkey AS search_id, c_nationkey % 6 AS kind, lower(n_name) AS candidate_country,
    TIMESTAMP '2000-01-01' AS last_seen_at,
    CASE WHEN c_nationkey % 6 = 3 THEN c_name END AS s_company, CASE WHEN c_nationkey % 6 = 4 THEN 30 END AS s_days,
    CASE WHEN c_nationkey % 6 IN (0, 5) THEN CASE WHEN c_acctbal > 5000 THEN 'senior' ELSE 'junior' END END AS s_level,
    CASE WHEN c_nationkey % 6 IN (2, 5) THEN lower(n_name) || ' city' END AS s_place, n_name AS s_place_label,
    CASE WHEN c_nationkey % 6 = 1 THEN lower(p_name) || ' ' || p_partkey END AS s_skill,
    CASE WHEN c_nationkey % 6 IN (0, 4) THEN string_split(lower(p_name), ' ')
         WHEN c_nationkey % 6 = 2 THEN [string_split(lower(p_name), ' ')[2]] ELSE []::VARCHAR[] END AS s_words,
    CASE WHEN c_nationkey % 6 = 2 THEN 'remote' WHEN c_nationkey % 6 = 5 THEN 'hybrid' END AS s_work
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN part ON c_custkey = p_partkey)"""


# ------------------------------------------------------------------ scopes
def scopes(spark: SparkSession, d: str) -> DataFrame:
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("scope"), F.lower("n_name").alias("country_name"))


# Scope members as a plain value: nation k of the generator lies in region k mod 5.
REGION_SCOPES = {r: tuple(f"nation_{k}" for k in range(25) if k % 5 == i)
                 for i, r in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}


# ------------------------------------------------------------------ posting pages
def order_pages(spark: SparkSession, d: str) -> DataFrame:
    """An HTML page per order, with headings, a list of its lines, entities and a style block."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    item = F.concat(F.lit("<li class=\"x\">"), (F.col("l_quantity")).cast("int").cast("string"),
                    F.when(F.col("l_returnflag") == "R", "+ years of experience with ")
                    .when(F.col("l_returnflag") == "A", "-60 years working on ").otherwise(" kinds of "),
                    "p_name", F.lit(" &amp;amp; more</li>"))
    li = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        *LINE_ORDER, item.alias("item")))).alias("items"))
    j = (o.join(c, o.o_custkey == c.c_custkey).join(li, o.o_orderkey == li.l_orderkey, "left"))
    st = F.col("o_orderstatus")
    head = F.when(st == "O", "Requirements").when(st == "F", "What you&#8217;ll need").otherwise("Our story")
    work = F.when(F.col("o_orderpriority") == "1-URGENT", "This is a fully remote role.").when(
        F.col("o_orderpriority") == "2-HIGH", "Hybrid, two days on-site").when(
        F.col("o_orderpriority") == "3-MEDIUM", "Work on site").otherwise("Remote - UK only")
    html = F.concat(
        F.lit("<style>p{margin:0}</style>&lt;p&gt;About "), "c_name", F.lit("&nbsp;&quot;Ltd&quot;&lt;/p&gt;<p>"),
        work, F.lit("<br/>Come along</p><h2>"), head, F.lit("</h2><ul>"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("")),
        F.lit("</ul><h3>Benefits</h3><p>Ten years of snacks and a red widget.</p>"))
    return j.select(F.col("o_orderkey").alias("order_id"),
                    F.concat_ws(" ", F.when(st == "O", "Senior").when(st == "F", "Jr"), "c_mktsegment",
                                F.lit("Analyst")).alias("title"),
                    F.when(F.col("o_orderpriority") != "5-LOW", "Berlin, Germany").alias("location"),
                    html.alias("html"))


ORDER_PAGES = """pages1 AS (SELECT o_orderkey AS order_id,
    concat_ws(' ', CASE o_orderstatus WHEN 'O' THEN 'Senior' WHEN 'F' THEN 'Jr' END, c_mktsegment, 'Analyst') AS title,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 'Berlin, Germany' END AS location,
    '<style>p{margin:0}</style>&lt;p&gt;About ' || c_name || '&nbsp;&quot;Ltd&quot;&lt;/p&gt;<p>' ||
    CASE o_orderpriority WHEN '1-URGENT' THEN 'This is a fully remote role.' WHEN '2-HIGH' THEN 'Hybrid, two days on-site'
      WHEN '3-MEDIUM' THEN 'Work on site' ELSE 'Remote - UK only' END || '<br/>Come along</p><h2>' ||
    CASE o_orderstatus WHEN 'O' THEN 'Requirements' WHEN 'F' THEN 'What you&#8217;ll need' ELSE 'Our story' END ||
    '</h2><ul>' || coalesce(items, '') || '</ul><h3>Benefits</h3><p>Ten years of snacks and a red widget.</p>' AS html
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (
    SELECT l_orderkey, string_agg('<li class="x">' || l_quantity::INTEGER || CASE l_returnflag
        WHEN 'R' THEN '+ years of experience with ' WHEN 'A' THEN '-60 years working on ' ELSE ' kinds of ' END ||
        p_name || ' &amp;amp; more</li>', '' ORDER BY """ + ", ".join(LINE_ORDER) + """) AS items
    FROM lines GROUP BY 1) ON o_orderkey = l_orderkey)"""


# ------------------------------------------------------------------ text lines
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document and conversation turn, as question-like labels."""
    docs = read(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("posting_id"), "text")
    conv = read(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("posting_id"), "text")
    return docs.unionByName(conv).select("posting_id", F.explode(F.split("text", "\n")).alias("label"))


TEXT_LINES = """tlines AS (SELECT posting_id, unnest(string_split(text, chr(10))) AS label FROM (
  SELECT 'd' || doc_id AS posting_id, text FROM documents UNION ALL
  SELECT 'c' || conv_id || '-' || turn, text FROM conversations))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
