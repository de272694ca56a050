"""Text facts: T1-T10 and the claims in a line, T20-T29."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia.functions import text as T
from vacantia.operators import index as X
from vacantia.operators import vocabulary as L

DOC_VOCAB = ("of the", "and the", "the", "that", "with", "and", "this", "for", "was", "from", "nicht", "dans")
PART_VOCAB = ("red widget", "blue widget", "cold widget", "hot bolt", "widget", "bolt", "red", "blue", "cold",
              "hot", "small", "large", "ring", "gear")


@query("html_to_text_pages", f"SELECT page_id, md5({Q.html('html')}) AS text_md5, length({Q.html('html')})::BIGINT AS chars FROM pages")
def html_to_text_pages(spark, d):
    return D.read(spark, d, "pages").withColumn("t", T.html_to_text("html")).select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("chars"))


@query("html_to_text_postings", D.with_ctes(D.LINES, D.ORDER_PAGES)
       + f"SELECT order_id, {Q.html('html')} AS body FROM pages1")
def html_to_text_postings(spark, d):
    return D.order_pages(spark, d).select("order_id", T.html_to_text("html").alias("body"))


def _sql_heading(x: str, words: str) -> str:
    t = Q.trim(x)
    return (f"(length({t}) BETWEEN 1 AND {V.HEADING_MAX} AND NOT {Q.has(t, V.BULLET_START)} "
            f"AND NOT {Q.has(t, '[.,;]$')} AND {Q.has(t, '(?i)' + chr(92) + 'b(?:' + words + ')' + chr(92) + 'b')})")


_SECTION_CTES = (
    D.LINES, D.ORDER_PAGES,
    f"txt AS (SELECT order_id, title, location, string_split({Q.html('html')}, chr(10)) AS ls FROM pages1)",
    f"hd AS (SELECT *, list_position(list_transform(ls, lambda x: {_sql_heading('x', V.HEADING_WORDS)}), true) AS h FROM txt)",
    "af AS (SELECT *, CASE WHEN coalesce(h, 0) > 0 THEN ls[h + 1:] ELSE []::VARCHAR[] END AS tail FROM hd)",
    f"st AS (SELECT *, list_position(list_transform(tail, lambda x: {_sql_heading('x', V.STOP_HEADING_WORDS)}), true) AS s FROM af)",
    "sec AS (SELECT *, coalesce(h, 0) > 0 AS found, CASE WHEN coalesce(h, 0) > 0 THEN "
    + Q.trim("array_to_string(CASE WHEN coalesce(s, 0) > 0 THEN tail[1:s - 1] ELSE tail END, chr(10))") + " ELSE '' END AS section FROM st)",
)


@query("requirements_section", D.with_ctes(*_SECTION_CTES) + "SELECT order_id, section, found FROM sec")
def requirements_section(spark, d):
    return (D.order_pages(spark, d).withColumn("t", T.html_to_text("html"))
            .withColumn("s", T.requirements_section("t"))
            .select("order_id", "s.section", "s.found"))


@query("terms_in_documents", f"SELECT doc_id, {Q.terms('text', DOC_VOCAB)} AS terms FROM documents")
def terms_in_documents(spark, d):
    return D.read(spark, d, "documents").select(
        "doc_id", F.array_join(T.terms_in("text", DOC_VOCAB), ",").alias("terms"))


@query("terms_in_parts", f"SELECT p_partkey, {Q.terms('p_name', PART_VOCAB)} AS terms FROM part")
def terms_in_parts(spark, d):
    return D.read(spark, d, "part").select(
        "p_partkey", F.array_join(T.terms_in("p_name", PART_VOCAB), ",").alias("terms"))


# Every part is a skill of its own, and its name without the number is a shorter one.
@query("terms_from_table", D.with_ctes(D.LINES, D.ASK) + """SELECT l_orderkey AS posting_id, array_to_string(list_sort(list_distinct(list_concat(skills, [lower(head)]))), ',') AS terms FROM ask""")
def terms_from_table(spark, d):
    """Texts that list an order's skills, against a vocabulary of all parts."""
    li = D.lines(spark, d)
    texts = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("skill")).alias("s"), F.min("p_name").alias("head")).select(
        F.col("l_orderkey").alias("posting_id"), F.concat(F.lit("We ask for: "), F.array_join("s", ", "), F.lit(". Or any "), F.upper("head"), F.lit(".")).alias("text"))
    p = D.read(spark, d, "part")
    vocab = L.vocabulary(p.select(F.explode(F.array("p_name", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))).alias("term")))
    return L.with_terms(texts, vocab, "posting_id", "text").select("posting_id", F.array_join("terms", ",").alias("terms"))


@query("level_of", D.with_ctes(D.POSTS_PLAIN) + "SELECT posting_id, "
       + Q.word_case(V.LEVEL_WORDS, "title") + " AS level FROM posts")
def level_of(spark, d):
    return D.postings(spark, d, with_skills=False).select("posting_id", T.level_of("title").alias("level"))


def _sql_workplace(title: str, text: str) -> str:
    w = lambda e, p: Q.has(e, rf"(?i)\b(?:{p})\b")
    return (f"CASE WHEN {w(title, 'hybrid')} THEN 'hybrid' WHEN {w(title, 'remote')} THEN 'remote' "
            f"WHEN {w(title, V.ONSITE_TITLE)} THEN 'onsite' WHEN {w(text, V.STRONG_REMOTE)} THEN 'remote' "
            f"WHEN {w(text, 'hybrid')} THEN 'hybrid' WHEN {w(text, V.ONSITE_BODY)} THEN 'onsite' "
            f"WHEN {w(text, 'remote')} THEN 'remote' END")


@query("workplace_of", D.with_ctes(D.LINES, D.ORDER_PAGES)
       + f"SELECT order_id, {_sql_workplace('title', Q.html('html'))} AS workplace FROM pages1")
def workplace_of(spark, d):
    return D.order_pages(spark, d).withColumn("t", T.html_to_text("html")).select(
        "order_id", T.workplace_of("title", "t").alias("workplace"))


_SCOPE_RE = (r"(?i)\b(?:remote|wfh)\b[^.\n]{0,30}?\b(" + V.SCOPE_NAMES + r")\b|\b(" + V.SCOPE_SHORT
             + r")[- ]?(?:only|based)\b")


def _sql_scope(loc: str, text: str) -> str:
    both = f"(coalesce({loc}, '') || chr(10) || {text})"
    raw = (f"lower(coalesce(nullif(regexp_extract({both}, {Q.lit(_SCOPE_RE)}, 1), ''), "
           f"nullif(regexp_extract({both}, {Q.lit(_SCOPE_RE)}, 2), '')))")
    return (f"CASE WHEN {raw} IN ('united states', 'usa', 'us') THEN 'US' "
            f"WHEN {raw} IN ('united kingdom', 'uk') THEN 'UK' ELSE upper({raw}) END")


@query("remote_scope_of", D.with_ctes(D.LINES, D.ORDER_PAGES)
       + f"SELECT order_id, {_sql_scope('location', Q.html('html'))} AS scope FROM pages1")
def remote_scope_of(spark, d):
    return D.order_pages(spark, d).withColumn("t", T.html_to_text("html")).select(
        "order_id", T.remote_scope_of("location", "t").alias("scope"))


# The check reads the form "<low>[-<high>][+] years ... <experience word>", which is how the lines are written.
def _sql_years(text: str) -> str:
    p = r"(?i)(?:^|[^0-9])([0-9]{1,2})\s*(?:\+|-|–|\s+to\s+)?\s*(?:[0-9]{1,2})?\s*\+?\s*years?\b[^.\n]{0,40}"
    hits = f"regexp_extract_all({text}, {Q.lit(p)}, 0)"
    nums = f"regexp_extract_all({text}, {Q.lit(p)}, 1)"
    return (f"list_transform(list_filter(list_zip({hits}, {nums}), lambda z: "
            + Q.has("z[1]", r"(?i)years?\b[^.\n]*(experience|exp\b|working|background|industry)")
            + " AND z[2]::INTEGER <= 30), lambda z: z[2]::INTEGER)[1]")


@query("required_years", D.with_ctes(D.LINES, D.ORDER_PAGES)
       + f"SELECT order_id, {_sql_years(Q.html('html'))} AS years FROM pages1")
def required_years(spark, d):
    return D.order_pages(spark, d).select("order_id", T.required_years(T.html_to_text("html")).alias("years"))


_NATION_RULES = tuple((rf"nation_{k}", f"Country {k}") for k in range(9))


@query("country_of", D.with_ctes(D.POSTS_PLAIN) + "SELECT posting_id, "
       + Q.word_case([(v, p) for p, v in _NATION_RULES], "lower(location)") + " AS country FROM posts")
def country_of(spark, d):
    return D.postings(spark, d, with_skills=False).select(
        "posting_id", T.country_of("location", _NATION_RULES).alias("country"))


@query("summary_of", "SELECT doc_id, substr(text, 1, 1400) AS summary, length(text)::INTEGER AS chars FROM documents")
def summary_of(spark, d):
    return D.read(spark, d, "documents").withColumn("s", T.summary_of("text")).select(
        "doc_id", "s.summary", "s.chars")


_GAZ = Q.word_case([(v, p) for p, v in V.GAZETTEER], "lower(location)")
_BODY = "array_to_string(ls, chr(10))"


@query("extract_facts", D.with_ctes(*_SECTION_CTES) + f"""SELECT order_id,
  {Q.terms("title || chr(10) || " + _BODY, PART_VOCAB)} AS skills,
  CASE WHEN found THEN {Q.terms('section', PART_VOCAB)} ELSE '' END AS required_skills, found AS requirements_found,
  {Q.word_case(V.LEVEL_WORDS, 'title')} AS level, {_sql_workplace('title', _BODY)} AS workplace,
  coalesce({_sql_years('section')}, {_sql_years(_BODY)}) AS years_required,
  CASE WHEN location IS NOT NULL THEN {_sql_scope('location', _BODY)} END AS remote_scope,
  {_GAZ} AS country, length({_BODY})::INTEGER AS description_chars, substr({_BODY}, 1, 1400) AS description FROM sec""")
def extract_facts(spark, d):
    f = X.extract_facts(D.order_pages(spark, d), PART_VOCAB)
    return f.select("order_id", F.array_join("skills", ",").alias("skills"),
                    F.array_join("required_skills", ",").alias("required_skills"), "requirements_found",
                    "level", "workplace", "years_required", "remote_scope", "country", "description_chars",
                    "description")


# ---------------------------------------------------------------- T20-T29


@query("posting_ref_pages", """WITH u AS (
  SELECT page_id, 'https://boards.greenhouse.io/' || CASE
      WHEN url LIKE '%/en/%' THEN 'acme' || '/jobs/' || page_id || CASE WHEN url LIKE '%#top' THEN '/application' ELSE '' END
      WHEN url LIKE '%/fr/%' THEN 'embed/job_app?for=beta&token=' || page_id
      WHEN url LIKE '%/de/%' THEN 'gamma/careers?gh_jid=' || page_id ELSE 'delta' END AS url,
    CASE WHEN url LIKE '%/en/%' THEN 'acme' WHEN url LIKE '%/fr/%' THEN 'beta' WHEN url LIKE '%/de/%' THEN 'gamma' END AS board
  FROM pages) SELECT page_id, board, CASE WHEN board IS NOT NULL THEN page_id::VARCHAR END AS external_id FROM u""")
def posting_ref_pages(spark, d):
    return _page_refs(spark, d).withColumn("r", T.posting_ref("link")).select(
        "page_id", "r.board", "r.external_id")


def _page_refs(spark, d):
    url, pid = F.col("url"), F.col("page_id").cast("string")
    tail = (F.when(url.contains("/en/"), F.concat(F.lit("acme/jobs/"), pid, F.when(
        url.endswith("#top"), "/application").otherwise("")))
        .when(url.contains("/fr/"), F.concat(F.lit("embed/job_app?for=beta&token="), pid))
        .when(url.contains("/de/"), F.concat(F.lit("gamma/careers?gh_jid="), pid)).otherwise("delta"))
    return D.read(spark, d, "pages").select("page_id", F.concat(F.lit("https://boards.greenhouse.io/"), tail).alias("link"))


@query("posting_ref_foreign_hosts", "SELECT page_id, NULL::VARCHAR AS board FROM pages")
def posting_ref_foreign_hosts(spark, d):
    return D.read(spark, d, "pages").select("page_id", T.posting_ref("url")["board"].alias("board"))


_CK = Q.squeeze(Q.sub("lower(nm)", "[’'']".replace("''", "'"), "'"))


@query("company_key", "WITH s AS (SELECT s_suppkey, s_name || CASE WHEN s_acctbal > 5000 THEN ', Inc.' WHEN s_acctbal > 2000 "
       "THEN ' Ltd' ELSE ' Careers' END AS nm FROM supplier) SELECT s_suppkey, "
       + Q.trim(Q.sub(Q.sub(_CK, V.COMPANY_SUFFIX, ""), "[^a-z0-9 ]", "")) + " AS company_key FROM s")
def company_key(spark, d):
    bal = F.col("s_acctbal")
    nm = F.concat("s_name", F.when(bal > 5000, ", Inc.").when(bal > 2000, " Ltd").otherwise(" Careers"))
    return D.read(spark, d, "supplier").select("s_suppkey", T.company_key(nm).alias("company_key"))


_NUM = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|(?:x|k|m|bn)\b)?"
_WORDS = ", ".join(f"CASE WHEN {Q.has('lower(text)', f'(^|[^a-z]){w}($|[^a-z])')} THEN '{i}' END"
                   for i, w in enumerate(V.NUMBER_WORDS))
_DIGITS = (f"list_transform(list_zip(regexp_extract_all(text, {Q.lit(_NUM)}, 1), regexp_extract_all(text, {Q.lit(_NUM)}, 2)), "
           r"lambda z: regexp_replace(replace(z[1], ',', ''), '\.0+$', '') || lower(coalesce(z[2], '')))")


@query("numbers_in", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
  list_filter([{_WORDS}], lambda x: x IS NOT NULL), {_DIGITS}))), ',') AS numbers FROM documents""")
def numbers_in(spark, d):
    return D.read(spark, d, "documents").select(
        "doc_id", F.array_join(F.array_sort(T.numbers_in("text")), ",").alias("numbers"))


_GROUPS = ", ".join(f"CASE WHEN {Q.has('lower(text)', f'(^|[^a-z])(?:{w})($|[^a-z])')} THEN '{g}' END"
                    for g, w in V.CREDIT_GROUPS.items())


@query("credit_groups_in", D.with_ctes(D.LINES, D.BULLETS)
       + f"SELECT text, concat_ws(',', {_GROUPS}) AS groups, count(*) AS n FROM bullets GROUP BY ALL")
def credit_groups_in(spark, d):
    return (D.bullets(spark, d).groupBy("text").agg(F.count("*").alias("n"))
            .select("text", F.array_join(T.credit_groups_in("text"), ",").alias("groups"), "n"))


@query("proper_nouns_in", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws
    FROM documents),
  c AS (SELECT doc_id, unnest(list_transform(ws, lambda x, i: {'w': regexp_replace(regexp_replace(x, '^[^\\w]+', ''), '[^\\w.+#/-]+$', ''),
      'starts': i = 1 OR regexp_matches(ws[i - 1], '[.!?]$')})) AS s FROM w)
  SELECT s.w AS noun, count(DISTINCT doc_id) AS docs FROM c WHERE NOT s.starts AND regexp_matches(s.w, '^[A-Z][A-Za-z0-9.+#/-]+$')
  GROUP BY 1""".replace("\\\\", "\\"))
def proper_nouns_in(spark, d):
    return (D.read(spark, d, "documents").select(F.explode(T.proper_nouns_in("text")).alias("noun"))
            .groupBy("noun").agg(F.count("*").alias("docs")))


@query("title_words", D.with_ctes(D.POSTS) + f"SELECT posting_id, array_to_string({Q.title_words('title')}, ',') AS words FROM posts")
def title_words(spark, d):
    return D.postings(spark, d).select("posting_id", F.array_join(T.title_words("title"), ",").alias("words"))


@query("title_matches", D.with_ctes(D.POSTS) + r"""SELECT posting_id,
  regexp_matches(lower(title), '(^|[^a-z0-9])red(s|es|ing)?($|[^a-z0-9])')
   AND regexp_matches(lower(title), '(^|[^a-z0-9])widget(s|es|ing)?($|[^a-z0-9])') AS all_words,
  regexp_matches(lower(title), '(^|[^a-z0-9])red(s|es|ing)?[\s/-]+widget(s|es|ing)?($|[^a-z0-9])') AS phrase FROM posts""")
def title_matches(spark, d):
    words = F.array(F.lit("red"), F.lit("widget"))
    return D.postings(spark, d).select("posting_id", T.title_matches("title", words).alias("all_words"),
                                       T.title_has_phrase("title", words).alias("phrase"))


@query("names_employer", """SELECT c_custkey, contains(lower(c_mktsegment || ' at ' || c_name), 'customer') AS named,
  false AS other FROM customer""")
def names_employer(spark, d):
    label = F.concat("c_mktsegment", F.lit(" at "), "c_name")
    return D.read(spark, d, "customer").select(
        "c_custkey", T.names_employer(label, "c_name").alias("named"),
        T.names_employer(label, F.concat(F.lit("un "), "c_mktsegment", F.lit("x"))).alias("other"))


@query("employer_name", """SELECT DISTINCT o_orderpriority AS token, array_to_string(list_transform(string_split(
    trim(regexp_replace(o_orderpriority, '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM orders""")
def employer_name(spark, d):
    return D.read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("token"), T.employer_name("o_orderpriority").alias("name")).distinct()


@query("label_from_key", """SELECT DISTINCT p_name AS key, upper(p_name[1]) || p_name[2:] AS label FROM part""")
def label_from_key(spark, d):
    return D.read(spark, d, "part").select(
        F.col("p_name").alias("key"), T.label_from_key(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label")).distinct()


@query("days_old", """SELECT event_id, floor(date_diff('millisecond', ts, TIMESTAMP '2024-01-31') / 86400000)::BIGINT AS days
  FROM events""")
def days_old(spark, d):
    return D.read(spark, d, "events").select(
        "event_id", T.days_old("ts", D.ts(D.EVENTS_NOW)).alias("days"))


@query("canonical_json", D.with_ctes(D.SEARCHES) + """SELECT search_id, '{"company":' || coalesce('"' || s_company || '"', 'null') || ',"days":' ||
  coalesce(s_days::VARCHAR, 'null') || ',"level":' || coalesce('"' || s_level || '"', 'null') || ',"place":' ||
  CASE WHEN s_place IS NULL THEN 'null' ELSE '{"label":"' || s_place_label || '","terms":["' || s_place || '"]}' END ||
  ',"skills":[' || coalesce('"' || s_skill || '"', '') || '],"words":[' ||
  coalesce(array_to_string(list_transform(s_words, lambda w: '"' || w || '"'), ','), '') || '],"workplace":' ||
  coalesce('"' || s_work || '"', 'null') || '}' AS text FROM srch""")
def canonical_json(spark, d):
    return D.searches(spark, d).select("search_id", T.canonical_json("f").alias("text"))
