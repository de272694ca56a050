"""Filters, eligibility, search, requests and saved searches: F1-F18."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia.functions import text as T
from vacantia.operators import requests as R
from vacantia.operators import search as S
from vacantia.session import materialise, spread

_NOW = "TIMESTAMP '2001-08-02'"


def _visible(spark, d):
    """The visible postings as a stored table, because a search reads them several times."""
    return materialise(S.visible_postings(D.postings(spark, d), D.boards(spark, d)))


_VIS = "vis AS (SELECT * FROM posts WHERE closed_at IS NULL AND board <> '3-MEDIUM')"


@query("visible_postings", D.with_ctes(D.POSTS_PLAIN, _VIS) + "SELECT posting_id, title FROM vis")
def visible_postings(spark, d):
    return S.visible_postings(D.postings(spark, d, with_skills=False), D.boards(spark, d)).select("posting_id", "title")


@query("filter_postings", D.with_ctes(D.POSTS_PLAIN) + f"""SELECT posting_id FROM posts WHERE country = 'NATION_3' AND remote
  AND form_readable AND posted_at >= {_NOW} - INTERVAL 365 DAY""")
def filter_postings(spark, d):
    return S.filter_postings(D.postings(spark, d, with_skills=False), D.now(), "NATION_3", True, True, 365).select("posting_id")


@query("distinct_companies", D.with_ctes(D.POSTS_PLAIN) + "SELECT DISTINCT company FROM posts WHERE closed_at IS NULL")
def distinct_companies(spark, d):
    return S.distinct_companies(D.postings(spark, d, with_skills=False))


# ---------------------------------------------------------------- F3, F4
def _rules(spark, d):
    n = D.read(spark, d, "nation").select(F.lower("n_name").alias("country"))
    return S.country_rules(n, D.scopes(spark, d), world=[f"nation_{k}" for k in range(25)])


def _pairs(spark, d):
    """Candidates and the postings of others in the same market segment and price band."""
    p = D.postings(spark, d, with_skills=False)
    li = D.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    c = D.candidates(spark, d, with_skills=False).select("candidate_id", "candidate_country", "last_name")
    # A supplier's number names the candidate who looks at the order.
    seen = li.withColumn("candidate_id", F.col("l_suppkey")).select("candidate_id", "l_orderkey").distinct()
    return (seen.join(c, "candidate_id").join(p, F.col("l_orderkey").cast("string") == F.col("external_id"))
            .withColumn("candidate_country", F.when(~F.col("last_name").endswith("7"), F.col("candidate_country")))
            .withColumn("posting_country", F.col("country")))


_SEEN = """seen AS (SELECT DISTINCT l_suppkey AS candidate_id, l_orderkey FROM lineitem),
  prs AS (SELECT s.candidate_id, CASE WHEN last_name NOT LIKE '%7' THEN candidate_country END AS cc, posts.* FROM seen s
    JOIN cands0 USING (candidate_id) JOIN posts ON l_orderkey::VARCHAR = external_id)"""
_MY_REGION = "(SELECT upper(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) = {c})"


def _sql_eligible(c: str, region: str) -> str:
    """Own scope is the candidate's region; names of nations outside it, and other nations, are "other"."""
    bare = "regexp_replace(lower(location), '^remote - ', '')"
    return (f"({c} IS NULL OR ((NOT remote OR CASE WHEN remote_scope IS NULL THEN location IS NULL OR NOT "
            f"(starts_with({bare}, 'nation_') AND NOT contains({bare}, ' ') AND {bare} <> {c}) ELSE remote_scope = {region} END) "
            f"AND (remote OR country IS NULL OR lower(country) = {c} OR lower(country) IN "
            f"(SELECT lower(n2.n_name) FROM nation n2 JOIN region r2 ON n2.n_regionkey = r2.r_regionkey WHERE r2.r_name = {region}))))")


@query("eligible_pairs", D.with_ctes(D.POSTS_PLAIN, D.CANDS_PLAIN, _SEEN,
       "reg AS (SELECT lower(n_name) AS nn, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey)")
       + f"SELECT candidate_id, posting_id FROM prs LEFT JOIN reg ON cc = nn WHERE {_sql_eligible('cc', 'rn')}")
def eligible_pairs(spark, d):
    return S.eligible(_pairs(spark, d), _rules(spark, d)).select("candidate_id", "posting_id")


@query("excluded_scopes", """SELECT lower(n_name) AS country, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region r WHERE r.r_regionkey <> n.n_regionkey)
  AS excluded, (SELECT count(*) FROM nation n2 WHERE n2.n_regionkey = n.n_regionkey)::INTEGER AS own, (SELECT count(*) - 1 FROM nation)::INTEGER AS other FROM nation n""")
def excluded_scopes(spark, d):
    return _rules(spark, d).select("country", F.array_join(F.array_sort("excluded_scopes"), ",").alias("excluded"),
                                   F.size("own_names").alias("own"), F.size("other_names").alias("other"))


@query("bare_country_of", D.with_ctes(D.POSTS_PLAIN) + """SELECT posting_id, CASE WHEN location LIKE 'Remote - %' THEN lower(location[10:])
  ELSE lower(location) END AS bare FROM posts""")
def bare_country_of(spark, d):
    return D.postings(spark, d, with_skills=False).select("posting_id", S.bare_country_of("location").alias("bare"))


@query("country_of_profile", D.with_ctes(D.CANDS_PLAIN) + "SELECT candidate_id, lower(trim(split_part(location, ',', 2))) AS country FROM cands0")
def country_of_profile(spark, d):
    return D.candidates(spark, d, with_skills=False).select(
        "candidate_id", S.country_of_profile("country", "location").alias("country"))


# ---------------------------------------------------------------- F5, F6
_FORMS = "lambda w: [w, w || 's', w || 'es', w || 'ing']"
_TOKENS = "toks AS (SELECT *, regexp_split_to_array(lower(title), '[^a-z0-9]+') AS tk FROM vis)"
_MATCH = f"""hits AS (SELECT s.search_id, s.candidate_country, s.last_seen_at, s.s_words, s.s_place, p.*,
    list_aggregate(list_transform(s_words, lambda w: list_has_any(tk, [w, w || 's', w || 'es', w || 'ing'])), 'bool_and') AS allw,
    CASE WHEN len(s_words) = 2 THEN regexp_matches(' ' || lower(title) || ' ', '[^a-z0-9]' || s_words[1] || '(s|es|ing)?[\\s/-]+' || s_words[2] || '(s|es|ing)?[^a-z0-9]') END AS adj
  FROM srch s JOIN toks p ON (s_company IS NULL OR company = s_company) AND (s_days IS NULL OR posted_at >= {_NOW} - INTERVAL 30 DAY)
    AND (s_level IS NULL OR level = s_level) AND (s_skill IS NULL OR list_contains(skills, s_skill))
    AND (s_work IS NULL OR workplace = s_work OR (s_work = 'remote' AND remote))
    AND (s_place IS NULL OR contains(lower(coalesce(location, '')), s_place))
    AND (len(s_words) = 0 OR contains(lower(title), s_words[1])))""".replace("\\\\", "\\")
_ELIG = f"""ok AS (SELECT hits.* FROM hits LEFT JOIN reg ON candidate_country = nn WHERE coalesce(allw, true)
    AND (s_place IS NOT NULL OR {_sql_eligible('candidate_country', 'rn')})),
  modes AS (SELECT *, CASE WHEN len(s_words) < 2 THEN true ELSE adj END AS phrase FROM ok),
  found AS (SELECT * FROM (SELECT *, bool_or(phrase) OVER (PARTITION BY search_id) AS anyp FROM modes) WHERE phrase OR NOT anyp)"""
_REG = "reg AS (SELECT lower(n_name) AS nn, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey)"
_SEARCH = D.with_ctes(D.POSTS, _VIS, D.SEARCHES, _TOKENS, _MATCH, _REG, _ELIG)


@query("search_postings", _SEARCH + """SELECT search_id, posting_id, CASE WHEN len(s_words) = 0 THEN NULL WHEN anyp THEN 'phrase' ELSE 'words' END AS title_match FROM found""")
def search_postings(spark, d):
    return S.search(_visible(spark, d), D.searches(spark, d), D.now(), _rules(spark, d), places=()).select(
        "search_id", "posting_id", "title_match")


@query("apply_filters", D.with_ctes(D.POSTS) + f"""SELECT p.posting_id FROM posts p JOIN customer ON owner_id = c_custkey WHERE
  contains(lower(title), 'widget') AND level = CASE WHEN c_acctbal > 5000 THEN 'senior' ELSE 'junior' END AND (workplace = 'remote' OR remote)
  AND contains(lower(coalesce(location, '')), 'city') AND posted_at >= {_NOW} - INTERVAL 900 DAY AND company = c_name""")
def apply_filters(spark, d):
    c = D.read(spark, d, "customer")
    none = F.array().cast("array<string>")
    f = F.struct(F.col("c_name").alias("company"), F.lit(900).alias("days"),
                 F.when(F.col("c_acctbal") > 5000, "senior").otherwise("junior").alias("level"),
                 F.struct(F.lit("x").alias("label"), F.array(F.lit("City")).alias("terms")).alias("place"),
                 none.alias("skills"), F.array(F.lit("Widget")).alias("words"), F.lit("remote").alias("workplace"))
    p = D.postings(spark, d).join(c.select(F.col("c_custkey").alias("owner_id"), f.alias("f")), "owner_id")
    return S.apply_filters(p, D.now(), places=()).select("posting_id")


# ---------------------------------------------------------------- F7, F8 requests
def _messages(spark, d):
    """A request per conversation turn: its number and role choose the wording, its text is kept."""
    c = D.read(spark, d, "conversations")
    cust = D.read(spark, d, "customer").select("c_custkey", "c_name")
    say = F.array(
        F.lit("Show me data engineer jobs in Bangalore"), F.lit("only remote ones from this week"),
        F.concat(F.lit("and python roles at "), F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("start over, senior manager in the US last 10 days"),
        F.lit("please show me some jobs"), F.lit("what about hybrid with sql and react native and salary"),
        F.lit("junior photographer in new delhi"), F.concat(F.lit("just "), F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit(" this month")))
    return (c.join(cust, c.conv_id == cust.c_custkey, "left").select(
        "conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("msg_id"),
        F.concat(F.element_at(say, (F.col("turn") % 8 + 1).cast("int")), F.lit(" "),
                 F.coalesce("text", F.lit(""))).alias("text")))


_VOCAB = ("python", "sql", "react native", "react")


def _parsed(spark, d):
    firms = D.read(spark, d, "customer").select(F.col("c_name").alias("company"))
    return R.parse_requests(_messages(spark, d), firms, _VOCAB)


@query("parse_requests", """WITH m AS (SELECT conv_id, turn, turn % 8 AS k, length(text) < 40 AS extra FROM conversations)
  SELECT conv_id || '-' || turn AS msg_id, CASE k WHEN 0 THEN 'Bengaluru' WHEN 3 THEN 'United States' WHEN 6 THEN 'Delhi NCR' END AS place,
   CASE k WHEN 1 THEN 'remote' WHEN 5 THEN 'hybrid' END AS workplace, CASE k WHEN 3 THEN 'senior' WHEN 6 THEN 'junior' END AS level,
   CASE WHEN k IN (2, 7) THEN c_name END AS company, CASE k WHEN 1 THEN 7 WHEN 3 THEN 10 WHEN 7 THEN 30 END AS days,
   CASE k WHEN 2 THEN 'python' WHEN 5 THEN 'react native,sql' END AS skills, k = 3 AS asks_reset, k IN (1, 2, 5, 7) AS refining,
   CASE k WHEN 5 THEN 'pay' ELSE '' END AS notes FROM m JOIN customer ON conv_id = c_custkey""")
def parse_requests(spark, d):
    return _parsed(spark, d).select(
        "msg_id", F.col("place.label").alias("place"), "workplace", "level", "company", "days",
        F.array_join("skills", ",").alias("skills"), "asks_reset", "refining", F.array_join("notes", ",").alias("notes"))


# The fold in SQL: state of turn t is read from the turns since the last fresh one.
@query("fold_conversation", """WITH m AS (SELECT conv_id, turn, turn % 8 AS k, length(text) < 40 AS extra FROM conversations),
  p AS (SELECT m.*, c_name, CASE k WHEN 0 THEN 'Bengaluru' WHEN 3 THEN 'United States' WHEN 6 THEN 'Delhi NCR' END AS place,
   CASE k WHEN 1 THEN 'remote' WHEN 5 THEN 'hybrid' END AS workplace, CASE k WHEN 3 THEN 'senior' WHEN 6 THEN 'junior' END AS level,
   CASE WHEN k IN (2, 7) THEN c_name END AS company, CASE k WHEN 1 THEN 7 WHEN 3 THEN 10 WHEN 7 THEN 30 END AS days,
   CASE k WHEN 2 THEN ['python'] WHEN 5 THEN ['react native', 'sql'] END AS skills,
   k = 3 OR (k IN (0, 6)) OR turn = min(turn) OVER (PARTITION BY conv_id) AS fresh, turn > min(turn) OVER (PARTITION BY conv_id) AS later
   FROM m JOIN customer ON conv_id = c_custkey),
  s AS (SELECT *, max(CASE WHEN fresh THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM p)
  SELECT conv_id, turn, last_value(place IGNORE NULLS) OVER w AS place, last_value(workplace IGNORE NULLS) OVER w AS workplace,
   last_value(level IGNORE NULLS) OVER w AS level, last_value(company IGNORE NULLS) OVER w AS company,
   last_value(days IGNORE NULLS) OVER w AS days,
   array_to_string(list_sort(list_distinct(flatten(coalesce(list(skills) FILTER (WHERE skills IS NOT NULL) OVER w, [])))), ',') AS skills,
   fresh AND later AS reset FROM s WINDOW w AS (PARTITION BY conv_id, seg ORDER BY turn)""")
def fold_conversation(spark, d):
    return R.fold_conversation(_parsed(spark, d), chunk=2).select(
        "conv_id", "turn", F.col("f.place.label").alias("place"), F.col("f.workplace").alias("workplace"),
        F.col("f.level").alias("level"), F.col("f.company").alias("company"), F.col("f.days").alias("days"),
        F.array_join(F.array_sort("f.skills"), ",").alias("skills"), "reset")


@query("parse_requests_documents")
def parse_requests_documents(spark, d):
    """Every line of every text as a request, whole texts: counts per named slot."""
    t = D.text_lines(spark, d).select(F.concat_ws("-", "posting_id", F.sha2("label", 256)).alias("msg_id"), F.col("label").alias("text"))
    p = R.parse_requests(spread(t, "msg_id", "text"), None, _VOCAB)  # a file of texts may be read by few tasks
    return p.agg(F.count("*").alias("n"), F.count("place").alias("place"), F.count("level").alias("level"),
                 F.count("days").alias("days"), F.count("skills").alias("skills"), F.count("words").alias("words"))


# ---------------------------------------------------------------- F9, F10
@query("filter_chips", D.with_ctes(D.SEARCHES) + """SELECT search_id, key, label FROM (
  SELECT search_id, 'words' AS key, '“' || array_to_string(s_words, ' ') || '” in the title' AS label FROM srch WHERE len(s_words) > 0
  UNION ALL SELECT search_id, 'skill:' || s_skill, 'skill: ' || s_skill FROM srch WHERE s_skill IS NOT NULL
  UNION ALL SELECT search_id, 'place', 'in ' || s_place_label FROM srch WHERE s_place IS NOT NULL
  UNION ALL SELECT search_id, 'workplace', s_work FROM srch WHERE s_work IS NOT NULL
  UNION ALL SELECT search_id, 'level', s_level FROM srch WHERE s_level IS NOT NULL
  UNION ALL SELECT search_id, 'company', 'at ' || s_company FROM srch WHERE s_company IS NOT NULL
  UNION ALL SELECT search_id, 'days', 'posted in the last 30 days' FROM srch WHERE s_days IS NOT NULL)""")
def filter_chips(spark, d):
    return D.searches(spark, d).select("search_id", F.explode(S.chips()).alias("c")).select("search_id", "c.key", "c.label")


@query("without_part", D.with_ctes(D.SEARCHES) + """SELECT search_id, s_company AS company, s_days AS days, NULL::VARCHAR AS level,
  s_place_label IS NOT NULL AND s_place IS NOT NULL AS has_place, len(s_words)::INTEGER AS n_words FROM srch WHERE s_level IS NOT NULL""")
def without_part(spark, d):
    s = D.searches(spark, d).where(F.col("f.level").isNotNull())
    return s.withColumn("f", S.without_part(F.lit("level"))).select(
        "search_id", "f.company", "f.days", "f.level", F.col("f.place").isNotNull().alias("has_place"),
        F.size("f.words").alias("n_words"))


def _narrow(spark, d):
    """Searches that ask for a company and for a level no posting of it needs to have."""
    s = D.searches(spark, d)
    return s.withColumn("f", F.col("f").withField("company", F.concat(F.lit("Customer#"), F.lpad(
        F.col("search_id").cast("string"), 9, "0"))).withField("level", F.lit("staff")).withField(
        "place", F.lit(None).cast("struct<label:string,terms:array<string>>")).withField(
        "workplace", F.lit(None).cast("string")))


@query("loosen", D.with_ctes(D.POSTS, _VIS, D.SEARCHES, _REG) + f"""SELECT search_id, 'level' AS key, 'staff' AS label, count(*) AS total FROM srch
  JOIN vis ON company = 'Customer#' || lpad(search_id::VARCHAR, 9, '0') AND (s_skill IS NULL OR list_contains(skills, s_skill))
   AND (s_days IS NULL OR posted_at >= {_NOW} - INTERVAL 30 DAY)
   AND (len(s_words) = 0 OR list_aggregate(list_transform(s_words, lambda w: list_has_any(regexp_split_to_array(lower(title), '[^a-z0-9]+'),
     [w, w || 's', w || 'es', w || 'ing'])), 'bool_and')) LEFT JOIN reg ON candidate_country = nn
  WHERE {_sql_eligible('candidate_country', 'rn')} AND NOT (len(s_words) = 2 AND NOT regexp_matches(' ' || lower(title) || ' ',
    '[^a-z0-9]' || s_words[1] || '(s|es|ing)?[^a-z0-9]+' || s_words[2] || '(s|es|ing)?[^a-z0-9]')) GROUP BY 1""")
def loosen(spark, d):
    return S.loosen(_visible(spark, d), _narrow(spark, d), D.now(), _rules(spark, d), places=())


# ---------------------------------------------------------------- F11-F16, F18
@query("saved_search_counts", _SEARCH + """SELECT search_id, false AS broken, count(f.posting_id) AS total,
  count(*) FILTER (WHERE first_seen_at > TIMESTAMP '2000-01-01') AS new_count FROM srch LEFT JOIN (SELECT search_id, posting_id, first_seen_at FROM found) f
  USING (search_id) GROUP BY 1""")
def saved_search_counts(spark, d):
    return S.saved_search_counts(D.searches(spark, d), _visible(spark, d), D.now(), _rules(spark, d), places=())


def _saves(spark, d):
    e = D.read(spark, d, "events")
    none = F.array().cast("array<string>")
    f = F.struct(F.lit(None).cast("string").alias("company"), F.get_json_object("props", "$.k").cast("int").alias("days"),
                 F.col("event_type").alias("level"), F.lit(None).cast("struct<label:string,terms:array<string>>").alias("place"),
                 none.alias("skills"), none.alias("words"), F.lit(None).cast("string").alias("workplace"))
    return e.select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("search_id"),
                    F.col("event_type").alias("label"), f.alias("f"), F.col("ts").alias("created_at"))


@query("save_searches", """SELECT candidate_id, search_id, n::INTEGER AS n, n <= 20 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ts, search_id) AS n FROM (
  SELECT user_id AS candidate_id, arg_min(event_id, (ts, event_id)) AS search_id, min(ts) AS ts FROM events
  GROUP BY user_id, event_type, json_extract_string(props, '$.k')))""")
def save_searches(spark, d):
    return S.save_searches(_saves(spark, d)).select("candidate_id", "search_id", "n", "accepted")


@query("mark_seen", """SELECT c_custkey AS search_id, greatest(TIMESTAMP '2000-01-01', max(ts)) AS last_seen_at FROM customer
  JOIN part ON c_custkey = p_partkey LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def mark_seen(spark, d):
    e = D.read(spark, d, "events").select(F.col("user_id").alias("search_id"), "ts")
    return S.mark_seen(D.searches(spark, d), e).select("search_id", "last_seen_at")


@query("new_first", D.with_ctes(D.POSTS_PLAIN) + """SELECT posting_id, first_seen_at > TIMESTAMP '2000-01-01' AS is_new FROM posts""")
def new_first(spark, d):
    p = D.postings(spark, d, with_skills=False).withColumn("rank", F.col("years_required"))
    return S.new_first(p, D.ts("2000-01-01 00:00:00")).select("posting_id", "is_new")


@query("page", D.with_ctes(D.POSTS_PLAIN) + """SELECT posting_id, (SELECT count(*) FROM posts) AS total, true AS has_more FROM posts
  ORDER BY posted_at DESC, posting_id LIMIT 60 OFFSET 120""")
def page(spark, d):
    p = D.postings(spark, d, with_skills=False)
    return S.page(p, [F.col("posted_at").desc_nulls_last(), F.col("posting_id")], 120, 60).select("posting_id", "total", "has_more")


@query("resolve_urls", """SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN CASE WHEN o_orderkey IS NULL THEN 'not indexed' ELSE 'found' END
  ELSE 'unreadable' END AS outcome, CASE WHEN url LIKE '%/en/%' THEN o_orderkey END AS order_id FROM pages LEFT JOIN orders
  ON o_orderkey = page_id AND o_orderpriority = '1-URGENT'""")
def resolve_urls(spark, d):
    urls = D.read(spark, d, "pages").select("page_id", F.when(
        F.col("url").contains("/en/"), F.concat(F.lit("https://boards.greenhouse.io/1-URGENT/jobs/"), F.col("page_id").cast("string")))
        .otherwise(F.col("url")).alias("url"))
    r = S.resolve_urls(urls, D.postings(spark, d, with_skills=False))
    return r.select("page_id", "outcome", F.when(F.col("outcome") == "found", F.col("external_id").cast("bigint")).alias("order_id"))
