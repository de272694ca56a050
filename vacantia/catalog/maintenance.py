"""Sources and index upkeep: S1-S27."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia import schemas
from vacantia.operators import index as X
from vacantia.operators import tracking as K
from vacantia.sources import files as B
from vacantia.session import shared_dir
from vacantia.sources import listings as L

_DAY = "1998-01-01 00:00:00"


def _text_a(spark, d):
    """Orders as first-vendor JSON text, one document per board and customer."""
    o, c = D.read(spark, d, "orders"), D.read(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    job = F.struct(
        F.when(F.col("o_totalprice") > 20000, F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("  "), F.when(F.col("o_orderstatus") != "P", F.col("c_mktsegment")).otherwise(""), F.lit(" "))
        .alias("title"),
        F.when(F.col("c_acctbal") > 0, F.struct(F.concat(F.lit(" "), "c_name").alias("name"))).alias("location"),
        F.when(F.col("c_acctbal") > 5000, F.concat("c_name", F.lit(" "))).alias("company_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'-02:00'").alias("updated_at"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.lit("&lt;p&gt;x&lt;/p&gt;")).alias("content"))
    return j.groupBy(F.col("o_orderpriority").alias("board"), "o_custkey").agg(
        F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("js"))


def _json_a(spark, d):
    return _text_a(spark, d).select("board", F.from_json("js", schemas.LISTING_A).alias("x")).select("board", "x.jobs")


_A = """SELECT 'greenhouse:' || o_orderpriority || ':' || o_orderkey AS posting_id, o_orderkey::VARCHAR AS external_id,
  o_orderpriority AS board, CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment ELSE '' END AS title,
  CASE WHEN c_acctbal > 5000 THEN c_name ELSE o_orderpriority END AS company,
  CASE WHEN c_acctbal > 0 THEN c_name END AS location, o_orderdate + INTERVAL 2 HOUR AS posted_at,
  CASE WHEN o_orderpriority <> '2-HIGH' THEN '&lt;p&gt;x&lt;/p&gt;' ELSE '' END AS html
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 20000"""
_COLS = ("posting_id", "external_id", "board", "title", "company", "location", "html")


@query("read_listing_a", _A)
def read_listing_a(spark, d):
    return L.read_listing_a(_json_a(spark, d)).select(*_COLS, F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


def _landed_a(spark, d):
    """The same documents landed as files, a folder per board; of every tenth customer the end is missing."""
    path = f"{shared_dir(spark)}/landed/{uuid.uuid4().hex}"
    cut = F.when(F.col("o_custkey") % 10 == 3, F.expr("substr(js, 1, length(js) - 5)")).otherwise(F.col("js"))
    _text_a(spark, d).select("board", cut.alias("js")).write.partitionBy("board").text(path)
    return L.quarantined(L.read_json(spark, path, schemas.LISTING_A, one_per_file=False))


@query("read_listing_files", _A + " AND o_custkey % 10 <> 3")
def read_listing_files(spark, d):
    return L.read_listing_a(_landed_a(spark, d)[0]).select(*_COLS, F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("quarantined_listings", """SELECT o_orderpriority AS board, count(DISTINCT o_custkey) AS n, 'not JSON of this kind' AS reason FROM orders WHERE o_custkey % 10 = 3 GROUP BY 1""")
def quarantined_listings(spark, d):
    return _landed_a(spark, d)[1].groupBy("board", "reason").agg(F.count("*").alias("n"))


def _json_b(spark, d):
    p = D.read(spark, d, "part")
    job = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("department"), F.lit(" team ").alias("team"),
        (F.col("p_size") != 7).alias("isListed"), F.when(F.col("p_size") > 40, True).alias("isRemote"),
        F.when(F.col("p_size") > 30, "Hybrid").when(F.col("p_size") < 10, "OnSite").otherwise("other").alias("workplaceType"),
        F.lit("2024-02-01T10:00:00Z").alias("publishedAt"), F.concat(F.lit("u/"), "p_name").alias("applyUrl"))
    doc = p.groupBy(F.col("p_brand").alias("board"), "p_size").agg(
        F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("js"))
    return doc.select("board", F.from_json("js", schemas.LISTING_B).alias("x")).select("board", "x.jobs")


@query("read_listing_b", """SELECT 'ashby:' || p_brand || ':' || p_partkey AS posting_id, p_name AS title, p_brand AS company,
  CASE WHEN p_size > 25 THEN p_type ELSE 'team' END AS department, 'u/' || p_name AS url,
  CASE WHEN p_size > 40 THEN 'remote' WHEN p_size > 30 THEN 'hybrid' WHEN p_size < 10 THEN 'onsite' END AS workplace_stated
  FROM part WHERE p_size <> 7""")
def read_listing_b(spark, d):
    return L.read_listing_b(_json_b(spark, d)).select(
        "posting_id", "title", "company", "department", "url", "workplace_stated")


def _rows_c(spark, d):
    e = D.read(spark, d, "events")
    js = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("text"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("createdAt"),
        F.struct(F.lit(" Oslo ").alias("location"), F.lit("").alias("team")).alias("categories"),
        F.col("props").alias("description")))
    return e.select(F.col("user_id").cast("string").alias("board"), F.from_json(js, schemas.LISTING_C).alias("x")).select("board", "x.*")


@query("read_listing_c", """SELECT 'lever:' || user_id || ':' || event_id AS posting_id, event_type AS title, 'Oslo' AS location,
  NULL::VARCHAR AS department, date_trunc('millisecond', ts) AS posted_at, props AS html FROM events WHERE event_type <> 'error'""")
def read_listing_c(spark, d):
    return L.read_listing_c(_rows_c(spark, d)).select(
        "posting_id", "title", "location", "department", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "html")


@query("union_vendors", f"""WITH a AS ({_A}) SELECT vendor, count(*) AS n, count(location) AS located, min(posting_id) AS first_id FROM (
  SELECT 'greenhouse' AS vendor, posting_id, location FROM a
  UNION ALL SELECT 'ashby', 'ashby:' || p_brand || ':' || p_partkey, NULL FROM part WHERE p_size <> 7
  UNION ALL SELECT 'lever', 'lever:' || user_id || ':' || event_id, 'Oslo' FROM events WHERE event_type <> 'error') GROUP BY 1""")
def union_vendors(spark, d):
    u = L.union_vendors(L.read_listing_a(_json_a(spark, d)), L.read_listing_b(_json_b(spark, d)), L.read_listing_c(_rows_c(spark, d)))
    return u.groupBy("vendor").agg(F.count("*").alias("n"), F.count("location").alias("located"), F.min("posting_id").alias("first_id"))


def _forms(spark, d):
    """Order lines as form JSON, one form per order, then read back with the form schema."""
    heads = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("head", "tail", "name", "kinds", "options"), t)])
                      for t in D.TEMPLATES])
    types = F.create_map(*[F.lit(x) for kv in {
        "short_text": "input_text", "long_text": "textarea", "file": "input_file",
        "single_select": "multi_value_single_select", "unknown": "input_hidden"}.items() for x in kv])
    li = D.lines(spark, d).withColumn("t", F.element_at(heads, (F.col("p_size") % len(D.TEMPLATES) + 1).cast("int")))
    field = lambda k: F.struct(
        F.concat(F.col("t.name"), F.when(k == "long_text", "_text").otherwise("")).alias("name"), types[k].alias("type"),
        F.when(F.col("t.options") != "", F.transform(F.split("t.options", r"\|"), lambda x: F.struct(
            x.alias("label"), F.lower(x).alias("value")))).alias("values"))
    label = F.concat(F.lit(" "), "t.head", F.when(F.col("t.tail") == "p_brand", F.col("p_brand"))
                     .when(F.col("t.tail") == "p_name", F.col("p_name")).otherwise(""))
    q = F.struct(*D.LINE_ORDER, F.struct(
        label.alias("label"), F.when(F.col("l_returnflag") == "R", True).alias("required"),
        F.transform(F.split("t.kinds", r"\+"), field).alias("fields")).alias("q"))
    forms = li.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(q)), lambda x: x["q"]).alias("questions"), F.max("l_tax").alias("tax"))
    js = F.to_json(F.struct(
        F.when(F.col("tax") < 0.08, F.col("questions")).alias("questions"),
        F.struct(F.array(F.lit("a"), F.lit("b")).alias("questions")).alias("demographic_questions"),
        F.array(F.struct(F.lit("gdpr").alias("type"), (F.col("tax") > 0.05).alias("requires_consent"))).alias("compliance")))
    return forms.select(F.col("l_orderkey").alias("posting_id"), F.from_json(js, schemas.FORM).alias("x")).select("posting_id", "x.*")


@query("flatten_form", D.with_ctes(
    D.LINES, D.QUESTIONS_RAW.replace("l_returnflag = 'R' AS required,", "l_returnflag = 'R' AS required, l_orderkey, l_tax,"),
    f"q AS (SELECT *, {Q.label_key('label')} AS label_key, max(l_tax) OVER (PARTITION BY l_orderkey) AS tax FROM qraw)")
    + f"""SELECT l_orderkey AS posting_id, position::INTEGER AS position, trim(label) AS label, label_key, required,
  replace(kinds, '+', ',') AS kinds, {Q.classify('label_key', 'kinds')} AS answerability,
  CASE WHEN opts <> '' THEN len(string_split(opts, '|'))::INTEGER END AS n_options FROM q WHERE tax < 0.08""")
def flatten_form(spark, d):
    return L.flatten_form(_forms(spark, d)).select(
        "posting_id", "position", "label", "label_key", "required",
        F.array_join(F.transform("fields", lambda f: f["kind"]), ",").alias("kinds"), "answerability",
        F.size(F.element_at("fields", 1)["options"]).alias("n_options"))


@query("form_summary", """SELECT l_orderkey AS posting_id, CASE WHEN max(l_tax) < 0.08 THEN count(*)::INTEGER END AS n_questions, 2 AS n_demographic,
  'gdpr' || CASE WHEN max(l_tax) > 0.05 THEN ' (consent required)' ELSE '' END AS notes FROM lineitem GROUP BY 1""")
def form_summary(spark, d):
    return L.form_summary(_forms(spark, d)).select(
        "posting_id", "n_questions", "n_demographic", F.array_join("compliance_notes", ";").alias("notes"))


@query("board_quality", f"""WITH a AS ({_A}), att AS (SELECT DISTINCT 'greenhouse' AS vendor, o_orderpriority AS board FROM orders)
  SELECT vendor, (SELECT count(*) FROM att) AS attempted, (SELECT count(*) FROM att WHERE board <> '5-LOW') AS live,
  (SELECT count(*) FROM a) AS jobs, (SELECT count(*) FROM a WHERE html = '') AS without_description FROM (SELECT DISTINCT vendor FROM att)""")
def board_quality(spark, d):
    att = D.read(spark, d, "orders").select(F.lit("greenhouse").alias("vendor"), F.col("o_orderpriority").alias("board")).distinct()
    return L.board_quality(att.withColumn("reached", F.col("board") != "5-LOW"), L.read_listing_a(_json_a(spark, d)))


# ---------------------------------------------------------------- upserts: old orders and a later listing
def _target(spark, d):
    return D.postings(spark, d, with_skills=False).where(F.col("posted_at") < D.ts("1999-01-01 00:00:00"))


def _snapshot(spark, d):
    """Listed now: orders that are not finished, with a changed title; forms of dear ones read."""
    p = D.postings(spark, d, with_skills=False).where(F.coalesce("level", F.lit("")) != "junior")
    return (p.withColumn("title", F.concat("title", F.lit(" (new)")))
            .withColumn("form_fetched_at", F.when(F.col("years_required") >= 5, D.now()))
            .withColumn("form_readable", F.lit(True)).drop("closed_at", "first_seen_at", "fetched_at"))


def _status(spark, d):
    b = D.boards(spark, d)
    return b.select("board", (F.col("board") != "5-LOW").alias("reached"))


_UP = ("tgt AS (SELECT * FROM posts WHERE posted_at < TIMESTAMP '1999-01-01')",
       "snap AS (SELECT * FROM posts WHERE coalesce(level, '') <> 'junior')",
       """up AS (SELECT coalesce(t.board, s.board) AS board, coalesce(t.external_id, s.external_id) AS external_id,
    CASE WHEN s.board IS NOT NULL THEN s.title || ' (new)' ELSE t.title END AS title,
    CASE WHEN s.board IS NULL THEN t.closed_at END AS closed_at,
    CASE WHEN t.board IS NOT NULL THEN t.first_seen_at ELSE TIMESTAMP '2001-08-02' END AS first_seen_at,
    CASE WHEN s.board IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE t.fetched_at END AS fetched_at,
    CASE WHEN s.years_required >= 5 THEN TIMESTAMP '2001-08-02' ELSE t.form_fetched_at END AS form_fetched_at,
    CASE WHEN s.years_required >= 5 THEN true ELSE t.form_readable END AS form_readable, s.board IS NOT NULL AS listed
  FROM tgt t FULL JOIN snap s ON t.board = s.board AND t.external_id = s.external_id)""")
_UPCOLS = ("board", "external_id", "title", "closed_at", "first_seen_at", "fetched_at", "form_fetched_at", "form_readable")


@query("upsert_postings", D.with_ctes(D.POSTS_PLAIN, *_UP) + f"SELECT {', '.join(_UPCOLS)} FROM up")
def upsert_postings(spark, d):
    return X.upsert_postings(_target(spark, d), _snapshot(spark, d), D.now()).select(*_UPCOLS)


def _closed(spark, d):
    snap = _snapshot(spark, d)
    return X.close_delisted(X.upsert_postings(_target(spark, d), snap, D.now()), snap, _status(spark, d), D.now())


@query("close_delisted", D.with_ctes(D.POSTS_PLAIN, *_UP) + """SELECT board, external_id, CASE WHEN closed_at IS NULL AND NOT listed
  AND board <> '5-LOW' THEN TIMESTAMP '2001-08-02' ELSE closed_at END AS closed_at FROM up""")
def close_delisted(spark, d):
    return _closed(spark, d).select("board", "external_id", "closed_at")


@query("replace_children", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
  WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')
  UNION ALL SELECT l_orderkey, l_linenumber, 0.0, 'new' FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'""")
def replace_children(spark, d):
    li = D.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    new = li.where(F.col("l_shipdate") >= D.ts("2000-01-01 00:00:00")).withColumn("l_quantity", F.lit(0.0)).withColumn(
        "l_returnflag", F.lit("new"))
    return X.replace_children(li.drop("l_shipdate"), new.drop("l_shipdate"), "l_orderkey")


def _fetches(spark, d):
    """A form fetch per order: unreached, unpublished, or a list of its lines (maybe empty)."""
    o = D.read(spark, d, "orders")
    li = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("qs"))
    q = F.when(F.col("o_orderstatus") != "P", F.coalesce("qs", F.array().cast("array<int>")))
    return (o.join(li, o.o_orderkey == li.l_orderkey, "left")
            .select("o_orderkey", "o_totalprice", (F.col("o_orderpriority") != "1-URGENT").alias("reached"), q.alias("questions")))


@query("form_state_from_fetch", """SELECT o_orderkey, o_orderstatus <> 'P' AS form_readable, TIMESTAMP '2001-08-02' AS form_fetched_at
  FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def form_state_from_fetch(spark, d):
    return X.form_state_from_fetch(_fetches(spark, d), D.now()).select("o_orderkey", "form_readable", "form_fetched_at")


@query("backfill_queue", D.with_ctes(D.POSTS_PLAIN) + """SELECT posting_id, posted_at FROM posts WHERE form_fetched_at IS NULL AND closed_at IS NULL
  ORDER BY posted_at DESC NULLS LAST, posting_id LIMIT 400""")
def backfill_queue(spark, d):
    return X.backfill_queue(D.postings(spark, d, with_skills=False), 400).select("posting_id", "posted_at")


@query("backfill_report", D.with_ctes(D.POSTS_PLAIN) + """SELECT count(*) AS attempted, count(*) FILTER (WHERE reached AND published) AS readable,
  count(*) FILTER (WHERE reached AND NOT published) AS unpublished, count(*) FILTER (WHERE NOT reached) AS unreachable,
  coalesce(sum(n) FILTER (WHERE reached AND published), 0)::BIGINT AS questions_written,
  (SELECT count(*) FROM posts WHERE form_fetched_at IS NULL AND closed_at IS NULL AND NOT form_readable) AS remaining FROM (
  SELECT o_orderpriority <> '1-URGENT' AS reached, o_orderstatus <> 'P' AS published, coalesce(n, 0) AS n FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_totalprice > 100000)""")
def backfill_report(spark, d):
    """A pass that asked the larger orders' forms."""
    p = D.postings(spark, d, with_skills=False).withColumn("o_orderkey", F.col("external_id").cast("bigint"))
    return X.backfill_report(_fetches(spark, d).where("o_totalprice > 100000"), p, "o_orderkey")


@query("backfill_facts", D.with_ctes(D.LINES, D.ORDER_PAGES) + """SELECT order_id, 1 AS facts_version,
  CASE WHEN title LIKE 'Senior%' THEN 'senior' WHEN title LIKE 'Jr%' THEN 'junior' END AS level FROM pages1
  WHERE location IS NOT NULL""")
def backfill_facts(spark, d):
    p = D.order_pages(spark, d).withColumn("facts_version", F.when(F.col("location").isNull(), 1))
    return X.backfill_facts(p, ("widget", "bolt")).select("order_id", "facts_version", "level")


@query("refresh_report", D.with_ctes(D.POSTS_PLAIN, *_UP) + """SELECT (SELECT count(DISTINCT board) FROM posts) AS boards, '5-LOW' AS failed,
  (SELECT count(*) FROM snap WHERE board <> '5-LOW') AS jobs_seen,
  (SELECT count(*) FROM up WHERE closed_at IS NOT NULL OR (NOT listed AND board <> '5-LOW'))
   - (SELECT count(*) FROM tgt WHERE closed_at IS NOT NULL) AS jobs_closed,
  (SELECT count(*) FROM up WHERE form_fetched_at IS NOT NULL) - (SELECT count(*) FROM tgt WHERE form_fetched_at IS NOT NULL) AS forms_read""")
def refresh_report(spark, d):
    n = _snapshot(spark, d).groupBy("board").agg(F.count("*").alias("n"))
    st = _status(spark, d).join(n, "board", "left").withColumn(
        "n_listed", F.when(F.col("reached"), F.coalesce("n", F.lit(0))).otherwise(0))
    return X.refresh_report(st, _target(spark, d), _closed(spark, d))


@query("index_is_stale", D.with_ctes(D.BOARDS) + """SELECT hours, date_diff('millisecond', newest, TIMESTAMP '2001-08-02') > hours * 3600000 AS stale
  FROM (SELECT max(last_fetched_at) AS newest FROM boards WHERE NOT disabled), (VALUES (1), (240)) v(hours)""")
def index_is_stale(spark, d):
    b = D.boards(spark, d)
    one = X.index_is_stale(b, 1, D.now()).select(F.lit(1).alias("hours"), "stale")
    return one.unionByName(X.index_is_stale(b, 240, D.now()).select(F.lit(240).alias("hours"), "stale"))


@query("index_health", D.with_ctes(D.POSTS_PLAIN, D.BOARDS) + """SELECT count(*) AS total, count(*) FILTER (WHERE closed_at IS NULL) AS open,
  (SELECT min(last_fetched_at) FROM boards WHERE NOT disabled) AS oldest_read,
  (SELECT max(last_fetched_at) FROM boards WHERE NOT disabled) AS newest_read FROM posts""")
def index_health(spark, d):
    return X.index_health(D.postings(spark, d, with_skills=False), D.boards(spark, d))


@query("dedupe_array_keep_order", """SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(ws),
    lambda w: {'i': list_position(ws, w), 'w': w})), lambda s: s.w), ' ') AS words
  FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)""")
def dedupe_array_keep_order(spark, d):
    return D.read(spark, d, "documents").select(
        "doc_id", F.array_join(X.dedupe_array_keep_order(F.split("text", " ")), " ").alias("words"))


@query("clamp_future_timestamps", """SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01'
  ELSE o_orderdate END AS o_orderdate FROM orders""")
def clamp_future_timestamps(spark, d):
    return X.clamp_future_timestamps(D.read(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", D.ts(_DAY))


# ---------------------------------------------------------------- S19-S23, S25-S27
def _files(spark, d):
    docs = D.read(spark, d, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".PDF").when(
        F.col("lang") == "fr", ".txt").when(F.col("lang") == "de", ".exe").otherwise(""))
    return docs.select("doc_id", name.alias("filename"), "source", "lang", F.encode(F.when(
        (F.col("lang") == "en") & (F.col("n_chars") > 500), F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")), "utf-8").alias("content"))


_FILES = """files AS (SELECT doc_id, lang, source, 'f' || doc_id || CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.exe' ELSE '' END AS filename,
  CASE WHEN lang = 'en' AND n_chars > 500 THEN '%PDF-' || text ELSE text END AS content FROM documents)"""
_KEY = "'resumes/' || sha256(content) || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.exe' ELSE '' END"


@query("content_address", D.with_ctes(_FILES) + f"SELECT doc_id, sha256(content) AS sha256, strlen(content)::INTEGER AS bytes, {_KEY} AS storage_key FROM files")
def content_address(spark, d):
    return B.content_address(_files(spark, d), filename="filename").select("doc_id", "sha256", "bytes", "storage_key")


@query("validate_uploads", D.with_ctes(_FILES) + """SELECT doc_id, CASE WHEN content = '' THEN 'empty' WHEN lang NOT IN ('en', 'fr') THEN 'extension'
  WHEN lang = 'en' AND content NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'not a pdf' END AS problem FROM files""")
def validate_uploads(spark, d):
    return B.validate_uploads(_files(spark, d)).select("doc_id", "problem")


@query("orphan_blobs", D.with_ctes(_FILES) + f"""SELECT DISTINCT {_KEY} AS storage_key FROM files WHERE source IN ('src1', 'src2') AND {_KEY} NOT IN
  (SELECT {_KEY} FROM files WHERE source NOT IN ('src1', 'src2'))""")
def orphan_blobs(spark, d):
    f = B.content_address(_files(spark, d), filename="filename").select("source", "storage_key")
    gone = F.col("source").isin("src1", "src2")
    return B.orphan_blobs(f.where(~gone), f.where(gone))


def _resume_files(spark, d):
    o = D.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("candidate_id"),
                    F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
                    F.col("o_orderdate").alias("uploaded_at"), (F.col("o_orderstatus") == "F").alias("active"))


@query("active_resume", """SELECT candidate_id, id FROM (SELECT o_custkey AS candidate_id, o_orderkey AS id, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS had,
    o_orderpriority = '1-URGENT' AS gone, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT',
    (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND had AND NOT gone""")
def active_resume(spark, d):
    gone = D.read(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("id"))
    return B.active_resume(_resume_files(spark, d), gone).select("candidate_id", "id")


def _variants(spark, d):
    c = D.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("candidate_id"), F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")))
                    .alias("name"), (F.col("c_acctbal") > 5000).alias("flag")).select(
        "candidate_id", "name", F.upper("name").alias("current_title"),
        F.when(F.col("name") == "view", F.array(F.lit("a b"))).otherwise(F.array().cast("array<string>")).alias("skills"),
        (F.col("flag") & (F.col("name") == "view")).alias("active"))


def _variant_events(spark, d):
    e = D.read(spark, d, "events")
    return e.select(F.col("user_id").alias("candidate_id"), "ts", "event_id",
                    F.when(F.col("event_type") != "signup", F.col("event_type")).alias("name"))


_VARIANTS = """vars AS (SELECT c_custkey AS candidate_id, name, upper(name) AS current_title, name = 'view' AS has_skill,
    c_acctbal > 5000 AND name = 'view' AS active FROM customer, (VALUES ('view'), ('click'), ('purchase')) v(name)),
  chosen AS (SELECT user_id, arg_max({'n': CASE WHEN event_type <> 'signup' THEN event_type END}, (ts, event_id)).n AS n
    FROM events WHERE event_type <> 'error' GROUP BY 1),
  vsel AS (SELECT vars.* EXCLUDE (active), CASE WHEN user_id IS NULL THEN active ELSE coalesce(name = n, false) END AS active
    FROM vars LEFT JOIN chosen ON candidate_id = user_id)"""


@query("select_variant", D.with_ctes(_VARIANTS) + "SELECT candidate_id, name, active FROM vsel")
def select_variant(spark, d):
    return K.select_variant(_variants(spark, d), _variant_events(spark, d)).select("candidate_id", "name", "active")


@query("normalise_profile", D.with_ctes(D.LINES, D.CANDS) + """SELECT candidate_id, first_name, coalesce(email, '') AS email, phone, current_title,
  len(skills)::INTEGER AS n_skills, concat_ws(',', CASE WHEN email IS NULL THEN 'email' END, CASE WHEN len(skills) > 80 THEN 'skills: too many' END) AS errors
  FROM cands""")
def normalise_profile(spark, d):
    c = D.candidates(spark, d).withColumn("first_name", F.concat(F.lit(" "), "first_name", F.lit("\t")))
    c = c.withColumn("skills", F.transform("skills", lambda s: F.concat(F.upper(s), F.lit(" "))))
    c = c.withColumn("current_title", F.coalesce("current_title", F.lit("  ")))
    return K.normalise_profile(c).select("candidate_id", "first_name", "email", "phone", "current_title",
                                         F.size("skills").alias("n_skills"), F.array_join("errors", ",").alias("errors"))


@query("erase_candidates", """SELECT 'orders' AS tbl, count(*) AS kept FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def erase_candidates(spark, d):
    c = D.read(spark, d, "customer").withColumnRenamed("c_custkey", "candidate_id")
    tables = {"orders": D.read(spark, d, "orders").withColumnRenamed("o_custkey", "candidate_id"), "customer": c,
              "events": D.read(spark, d, "events").withColumnRenamed("user_id", "candidate_id")}
    left = K.erase_candidates(tables, c.where(F.col("c_acctbal") < 0))
    out = [df.agg(F.count("*").alias("kept")).select(F.lit(n).alias("tbl"), "kept") for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("export_candidates", D.with_ctes(D.APPS, _VARIANTS) + """SELECT c_custkey AS candidate_id, c_name AS name,
  coalesce((SELECT string_agg(posting_id || '=' || status, ';' ORDER BY created_at, posting_id) FROM apps WHERE candidate_id = c_custkey), '') AS applications,
  'click,purchase,view' AS variants, CASE WHEN c_acctbal >= 0 THEN 4 ELSE 3 END AS n_answers,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::INTEGER AS n_resumes FROM customer""")
def export_candidates(spark, d):
    prof = D.candidates(spark, d, with_skills=False)
    files = _resume_files(spark, d).withColumn("bytes", F.lit(1)).withColumn("sha256", F.sha2("filename", 256))
    searches = D.searches(spark, d)
    out = K.export_candidates(prof, K.application_state(D.app_events(spark, d)), D.bank(spark, d), searches,
                              _variants(spark, d), files)
    return out.select(
        "candidate_id", F.concat_ws("#", "profile.first_name", "profile.last_name").alias("name"),
        F.array_join(F.transform("applications", lambda a: F.concat(a["posting_id"], F.lit("="), a["status"])), ";").alias("applications"),
        F.array_join(F.transform("variants", lambda v: v["name"]), ",").alias("variants"),
        F.size("saved_answers").alias("n_answers"), F.size("resumes").alias("n_resumes"))
