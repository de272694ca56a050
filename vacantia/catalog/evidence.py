"""Evidence: W11-W16, A14, P10, V1-V3, J10."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.catalog import sqlparts as Q
from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia.functions import text as T
from vacantia.operators import evidence as E
from vacantia.operators import tracking as K
from vacantia.session import materialise

VOCAB = ("red widget", "blue widget", "widget", "red", "bolt", "ring", "gear", "cold")
# What each market segment's posting asks for.
ASKS = {"AUTOMOBILE": (("red widget", "bolt"), ("gear",)), "BUILDING": (("ring",), ("red", "cold")),
        "FURNITURE": ((), ("widget", "bolt")), "HOUSEHOLD": (("gear", "cold"), ()), "MACHINERY": ((), ())}


def _asks(spark, d):
    c = D.read(spark, d, "customer")

    def pick(i):
        m = F.create_map(*[x for seg, a in ASKS.items() for x in
                           (F.lit(seg), F.array(*[F.lit(t) for t in a[i]]).cast("array<string>"))])
        return m[F.col("c_mktsegment")]

    return c.select(F.col("c_custkey").alias("candidate_id"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("posting_id"),
                    pick(0).alias("required_skills"), pick(1).alias("skills"))


def _lines(spark, d):
    """Evidence lines with their terms; the terms of equal texts are found once.

    The lines of an order are numbered first, where the orders are met, and dealt by candidate once with that number alone: it serves
    their places, the asks and the ranks.  The terms are written, so that their size is known.
    """
    b = D.bullets(spark, d)
    terms = materialise(b.select("text").distinct().withColumn("terms", T.terms_in("text", VOCAB)))
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*D.LINE_ORDER))
    w = Window.partitionBy("candidate_id", "role_no").orderBy("o_orderkey", "_line")
    placed = (b.withColumn("_line", line).select("candidate_id", "role_no", "o_orderkey", "_line", "text").repartition("candidate_id")
              .withColumn("position", F.row_number().over(w)))
    return placed.select("candidate_id", "role_no", "position", "text").join(terms, "text")


def _list(xs) -> str:
    return "[" + ", ".join(Q.lit(x) for x in xs) + "]::VARCHAR[]"


_ASKS_SQL = "asks(seg, required, mentioned) AS (VALUES " + ", ".join(
    f"({Q.lit(s)}, {_list(r)}, {_list(m)})" for s, (r, m) in ASKS.items()) + ")"
_TAILOR = (D.LINES, D.BULLETS, _ASKS_SQL,
           f"tt AS (SELECT text, string_split({Q.terms('text', VOCAB)}, ',') AS terms FROM (SELECT DISTINCT text FROM bullets))",
           "bl AS (SELECT candidate_id, role_no, text, row_number() OVER (PARTITION BY candidate_id, role_no ORDER BY o_orderkey, "
           + ", ".join(D.LINE_ORDER) + ") AS position FROM bullets)",
           """sc AS (SELECT bl.*, list_intersect(terms, list_concat(required, mentioned)) AS matched,
    len(list_intersect(terms, list_concat(required, mentioned))) + len(list_intersect(terms, required)) AS score, required, mentioned
    FROM bl JOIN tt USING (text) JOIN customer ON c_custkey = candidate_id JOIN asks ON seg = c_mktsegment)""",
           "tl AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, role_no ORDER BY score DESC, position) AS rank FROM sc)")


@query("tailor_bullets", D.with_ctes(*_TAILOR) + """SELECT candidate_id, role_no, position::INTEGER AS position, score::INTEGER AS score,
  rank::INTEGER AS rank, rank <= 4 AS kept FROM tl""")
def tailor_bullets(spark, d):
    return E.tailor_bullets(_lines(spark, d), _asks(spark, d)).select("candidate_id", "role_no", "position", "score", "rank", "kept")


@query("base_resume", D.with_ctes(*_TAILOR) + "SELECT candidate_id, role_no, position::INTEGER AS position, position::INTEGER AS rank, text FROM bl")
def base_resume(spark, d):
    return E.base_resume(_lines(spark, d)).select("candidate_id", "role_no", "position", "rank", "text")


@query("coverage_partition", D.with_ctes(*_TAILOR) + """SELECT candidate_id, array_to_string(list_sort(list_intersect(list_concat(any_value(required), any_value(mentioned)),
    flatten(list(matched) FILTER (WHERE rank <= 4)))), ',') AS evidenced,
  array_to_string(list_sort(list_filter(list_concat(any_value(required), any_value(mentioned)), lambda a: NOT list_contains(flatten(list(matched) FILTER (WHERE rank <= 4)), a)
    AND a = 'gear')), ',') AS claimed_not_shown,
  array_to_string(list_sort(list_filter(list_concat(any_value(required), any_value(mentioned)), lambda a: NOT list_contains(flatten(list(matched) FILTER (WHERE rank <= 4)), a)
    AND a <> 'gear')), ',') AS missing FROM tl GROUP BY 1""")
def coverage_partition(spark, d):
    asks = _asks(spark, d)
    t = E.tailor_bullets(_lines(spark, d), asks).where("kept")
    shown = t.select("candidate_id", F.explode_outer("matched").alias("m")).groupBy("candidate_id").agg(F.collect_set("m").alias("shown"))
    p = E.coverage_partition(F.array_union("required_skills", "skills"), "shown", F.array(F.lit("gear")))
    j = lambda n: F.array_join(F.array_sort(F.col("p." + n)), ",").alias(n)
    return asks.join(shown, "candidate_id").withColumn("p", p).select("candidate_id", j("evidenced"), j("claimed_not_shown"), j("missing"))


@query("verbatim_integrity", "SELECT 0::BIGINT AS not_found")
def verbatim_integrity(spark, d):
    src = materialise(_lines(spark, d))
    kept = E.tailor_bullets(src, _asks(spark, d)).where("kept")
    return E.verbatim_integrity(kept, src).agg(F.count("*").alias("not_found"))


# ---------------------------------------------------------------- W15, W16, A14
def _profiles(spark, d):
    """Profiles with lower-case part names as skills, experience, and asked terms for some."""
    b = D.bullets(spark, d)
    sk = b.where(F.col("l_quantity") > 48).groupBy("candidate_id").agg(F.array_sort(F.collect_set(F.upper("p_name"))).alias("skills"))
    c = D.candidates(spark, d, with_skills=False, with_experience=True).join(sk, "candidate_id", "left")
    asks = _asks(spark, d).select("candidate_id", F.array_union("required_skills", "skills").alias("a"))
    return c.join(asks, "candidate_id").withColumn("asks", F.when(F.col("years_experience").isNotNull(), F.transform(
        "a", lambda x: F.concat(x, F.when(x.isin("red", "cold"), " widget").otherwise("")))))


_AN = D.with_ctes(
    D.LINES, D.BULLETS, D.ROLES, D.CANDS_PLAIN, _ASKS_SQL,
    "sk AS (SELECT candidate_id, list_sort(list(DISTINCT upper(p_name))) AS skills FROM bullets WHERE l_quantity > 48 GROUP BY 1)",
    """rr AS (SELECT candidate_id, count(*) AS n_roles, bool_or(start IS NULL) AS undated, bool_or(len(bullets) < 2) AS thin, bool_or(company IS NULL) AS nameless,
    flatten(list(bullets)) AS bl FROM roles GROUP BY 1)""",
    """pr AS (SELECT c.*, coalesce(skills, []::VARCHAR[]) AS skills, coalesce(n_roles, 0) AS n_roles, undated, thin, nameless, coalesce(bl, []::VARCHAR[]) AS bl,
    lower(array_to_string(coalesce(bl, []::VARCHAR[]), chr(10))) AS hay,
    CASE WHEN years_experience IS NOT NULL THEN list_transform(list_concat(required, mentioned), lambda x: CASE WHEN x IN ('red', 'cold') THEN x || ' widget' ELSE x END) END AS asks
    FROM cands0 c JOIN customer ON c_custkey = c.candidate_id JOIN asks a ON seg = c_mktsegment LEFT JOIN sk USING (candidate_id) LEFT JOIN rr USING (candidate_id))""",
    r"""m AS (SELECT *, coalesce(len(asks), 0) AS na, len(list_filter(asks, lambda a: list_contains(list_transform(skills, lambda s: lower(s)), a))) AS hit,
    len(list_filter(skills, lambda s: contains(hay, lower(s)))) AS shown, len(bl) AS nb,
    len(list_filter(bl, lambda b: regexp_matches(b, '(\d+(\.\d+)?\s*%|[$£€₹]\s?\d|\b\d[\d,]*\b)'))) AS qn,
    (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (linkedin IS NOT NULL)::INT + (current_title IS NOT NULL)::INT + 3 AS filled FROM pr)""",
    """cat AS (SELECT candidate_id, 'keywords' AS key, CASE WHEN na > 0 THEN 25 ELSE 0 END AS weight, CASE WHEN na > 0 THEN floor(hit / na * 100 + 0.5) ELSE 0 END AS score FROM m
    UNION ALL SELECT candidate_id, 'evidence', 20, CASE WHEN len(skills) > 0 THEN floor(shown / len(skills) * 100 + 0.5) ELSE 0 END FROM m
    UNION ALL SELECT candidate_id, 'impact', 20, CASE WHEN nb > 0 THEN floor(least(1.0, qn / nb / 0.66::DOUBLE) * 100 + 0.5) ELSE 0 END FROM m
    UNION ALL SELECT candidate_id, 'structure', 15, CASE WHEN n_roles = 0 THEN 0 ELSE 100 - CASE WHEN undated THEN 30 ELSE 0 END - CASE WHEN thin THEN 20 ELSE 0 END
      - CASE WHEN nameless THEN 20 ELSE 0 END END FROM m
    UNION ALL SELECT candidate_id, 'completeness', 10, floor(filled / 7 * 100 + 0.5) FROM m
    UNION ALL SELECT candidate_id, 'ats', 10, CASE WHEN email IS NULL OR phone IS NULL THEN 70 ELSE 100 END FROM m)""",
    "tot AS (SELECT candidate_id, floor(sum(score * weight) / sum(weight) + 0.5)::INTEGER AS score FROM cat WHERE weight > 0 GROUP BY 1)")


@query("analyse_resume", _AN + "SELECT candidate_id, key, weight, score::INTEGER AS score FROM cat")
def analyse_resume(spark, d):
    return E.analyse_resume(_profiles(spark, d)).select("candidate_id", "key", "weight", "score")


@query("resume_score", _AN + "SELECT candidate_id, score, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 50 THEN 'fair' ELSE 'weak' END AS band FROM tot")
def resume_score(spark, d):
    return E.resume_score(E.analyse_resume(_profiles(spark, d)))


_FIX = """fx AS (SELECT * FROM (
    SELECT candidate_id, 0 AS o, 0 AS n, 'keywords' AS key, 1 AS severity, asks IS NULL AS t FROM m
    UNION ALL SELECT candidate_id, 0, 3, 'keywords', 1, na > 0 AND hit < na FROM m
    UNION ALL SELECT candidate_id, 1, 0, 'evidence', 2, len(skills) = 0 FROM m
    UNION ALL SELECT candidate_id, 1, 2, 'evidence', 1, len(skills) > 0 AND shown < len(skills) FROM m
    UNION ALL SELECT candidate_id, 1, 3, 'evidence', 2, len(list_filter(skills, lambda s: NOT contains(hay, lower(s)) AND list_contains(asks, lower(s)))) > 0 FROM m
    UNION ALL SELECT candidate_id, 2, 0, 'impact', 2, nb = 0 FROM m
    UNION ALL SELECT candidate_id, 2, 1, 'impact', CASE WHEN qn / nb >= 0.25 THEN 1 ELSE 2 END, nb > 0 AND qn / nb < 0.5 FROM m
    UNION ALL SELECT candidate_id, 2, 2, 'impact', 1, len(list_filter(bl, lambda b: b LIKE 'Responsible for%')) > 0 FROM m
    UNION ALL SELECT candidate_id, 3, 0, 'structure', 2, n_roles = 0 FROM m
    UNION ALL SELECT candidate_id, 3, 1, 'structure', 2, undated FROM m
    UNION ALL SELECT candidate_id, 3, 2, 'structure', 1, thin FROM m
    UNION ALL SELECT candidate_id, 3, 3, 'structure', 2, nameless FROM m
    UNION ALL SELECT candidate_id, 4, 1, 'completeness', 1, filled < 7 FROM m
    UNION ALL SELECT candidate_id, 4, 2, 'completeness', 2, resume_name IS NULL FROM m
    UNION ALL SELECT candidate_id, 5, 2, 'ats', 2, email IS NULL OR phone IS NULL FROM m) WHERE t)"""


@query("top_fixes", _AN.rstrip() + ",\n" + _FIX + """ SELECT candidate_id, rank::INTEGER AS rank, key, severity FROM (SELECT *,
  row_number() OVER (PARTITION BY candidate_id ORDER BY severity DESC, o, n) AS rank FROM fx) WHERE rank <= 5""")
def top_fixes(spark, d):
    return E.top_fixes(E.analyse_resume(_profiles(spark, d))).select("candidate_id", "rank", "key", "severity")


# ---------------------------------------------------------------- P10
def _letter_pairs(spark, d):
    p = D.postings(spark, d).select("posting_id", F.col("owner_id").alias("candidate_id"), F.col("board").alias("p_board"),
                                    F.when(F.col("level") == "senior", F.col("company")).alias("p_company"), F.col("title").alias("p_title"),
                                    F.col("location").alias("p_location"), F.col("required_skills").alias("asks"))
    c = D.candidates(spark, d).withColumn("website", F.lit(None).cast("string")).withColumn("github", F.lit(" "))
    x = D.experience(spark, d).select("candidate_id", K.current_company("experience").alias("current_company"))
    return p.join(c.join(x, "candidate_id", "left"), "candidate_id")


@query("letter_facts", D.with_ctes(D.POSTS, D.CANDS, D.BULLETS, D.ROLES,
       """cc AS (SELECT candidate_id, CASE WHEN count(*) FILTER (WHERE "end" IS NULL) = 1 THEN max(company) FILTER (WHERE "end" IS NULL) END AS current_company FROM roles GROUP BY 1)""",
       "lp AS (SELECT p.*, c.* EXCLUDE (location, skills, country), c.location AS my_location, current_company, list_filter(required_skills, lambda a: list_contains(c.skills, a)) AS shared "
       "FROM posts p JOIN cands c ON owner_id = candidate_id LEFT JOIN cc USING (candidate_id))")
       + """SELECT candidate_id, posting_id, (3 + 1 + 1 - CASE WHEN location IS NULL THEN 1 ELSE 0 END + CASE WHEN current_title IS NULL THEN 0 ELSE 1 END
    + CASE WHEN current_company IS NULL THEN 0 ELSE 1 END + CASE WHEN email IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 1 END
    + CASE WHEN len(shared) > 0 THEN 1 ELSE 0 END + CASE WHEN linkedin IS NULL THEN 0 ELSE 1 END)::INTEGER AS n_facts, array_to_string(shared, ',') AS shared,
  concat_ws('|', 'one thing you built', 'why this employer', CASE WHEN current_title IS NULL OR current_company IS NULL THEN 'current role' END,
    CASE WHEN email IS NULL AND phone IS NULL THEN 'contact' END) AS placeholders,
  concat_ws('|', CASE WHEN current_title IS NULL THEN 'current_title' END, CASE WHEN current_company IS NULL THEN 'current_company' END,
    CASE WHEN linkedin IS NULL THEN 'website / github / linkedin' END, CASE WHEN email IS NULL AND phone IS NULL THEN 'email / phone' END) AS would_help FROM lp""")
def letter_facts(spark, d):
    return E.letter_facts(_letter_pairs(spark, d)).select(
        "candidate_id", "posting_id", F.size("facts").alias("n_facts"), F.array_join("shared", ",").alias("shared"),
        F.array_join("placeholders", "|").alias("placeholders"), F.array_join("would_help", "|").alias("would_help"))


# ---------------------------------------------------------------- V1-V3
def _rewordings(spark, d):
    """Each evidence line with a proposal made from its neighbours' words."""
    b = D.bullets(spark, d).withColumn("bullet_id", F.concat_ws("-", "l_orderkey", *[F.col(c).cast("string") for c in D.LINE_ORDER]))
    p = (F.when(F.col("l_discount") < 0.02, F.concat(F.lit(" "), F.upper("text"), F.lit(" ")))
         .when(F.col("l_discount") < 0.03, F.lit("  "))
         .when(F.col("l_discount") < 0.05, F.concat(F.lit("Owned the best "), "p_name", F.lit(" line at Acme for twelve years, 40% up")))
         .when(F.col("l_discount") < 0.07, F.concat(F.regexp_replace("text", "units", "Units"), F.lit(" in a team that was very good at all of the things it did then")))
         .otherwise(F.regexp_replace("text", "^(Led|Shipped|Responsible for)", "Sent")))
    return b.select("bullet_id", F.col("text").alias("original"), p.alias("proposal"))


_PROP = """rw AS (SELECT text AS original, CASE WHEN l_discount < 0.02 THEN ' ' || upper(text) || ' ' WHEN l_discount < 0.03 THEN '  '
    WHEN l_discount < 0.05 THEN 'Owned the best ' || p_name || ' line at Acme for twelve years, 40% up'
    WHEN l_discount < 0.07 THEN regexp_replace(text, 'units', 'Units') || ' in a team that was very good at all of the things it did then'
    ELSE regexp_replace(text, '^(Led|Shipped|Responsible for)', 'Sent') END AS proposal, l_discount, l_quantity, l_linestatus, l_returnflag, p_name FROM bullets)"""
# The proposals are built, so which objections they meet is known from their parts.
_KINDS = """concat_ws(',', CASE WHEN l_discount >= 0.03 AND l_discount < 0.05 AND l_linestatus = 'F' AND l_quantity <> 12 THEN 'dropped-number' END,
    CASE WHEN l_discount >= 0.03 AND l_discount < 0.05 THEN 'escalation' END,
    CASE WHEN (l_discount >= 0.03 AND l_discount < 0.05 AND l_returnflag <> 'R') OR (l_discount >= 0.05 AND l_discount < 0.07) THEN 'inflated' END,
    CASE WHEN (l_discount >= 0.03 AND l_discount < 0.05) OR (l_discount >= 0.05 AND l_discount < 0.07 AND l_linestatus IN ('F', 'O')) THEN 'new-entity' END,
    CASE WHEN l_discount >= 0.03 AND l_discount < 0.05 THEN 'new-number' END)"""


@query("verify_rewordings", D.with_ctes(D.LINES, D.BULLETS, _PROP) + f"""SELECT original, proposal, CASE WHEN l_discount < 0.02 THEN 'unchanged'
  WHEN l_discount < 0.03 THEN 'empty' ELSE {_KINDS} END AS kinds, count(*) AS n FROM rw GROUP BY ALL""")
def verify_rewordings(spark, d):
    r = _rewordings(spark, d).groupBy("original", "proposal").agg(F.count("*").alias("n"))
    v = E.verify_rewordings(r, VOCAB)
    return v.select("original", "proposal", F.array_join(F.array_sort(F.array_distinct(F.transform(
        "objections", lambda o: o["kind"]))), ",").alias("kinds"), "n")


@query("verify_rewordings_turns")
def verify_rewordings_turns(spark, d):
    """Every turn of every conversation against the one before it: objections by kind, whole texts."""
    c = D.read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("original", F.lag("text").over(w)).where(F.col("original").isNotNull()).select(
        "conv_id", "turn", "original", F.col("text").alias("proposal"))
    v = E.verify_rewordings(pairs, VOCAB)
    return v.select(F.explode("objections").alias("o")).groupBy("o.kind").agg(F.count("*").alias("n"))


@query("triage_proposals", D.with_ctes(D.LINES, D.BULLETS, "pp AS (SELECT l_orderkey, arg_min(text, (l_linenumber, text)) AS original, "
       "arg_min(l_returnflag, (l_linenumber, text)) AS flag FROM bullets GROUP BY 1)") + """SELECT l_orderkey AS bullet_id, CASE WHEN flag = 'A' THEN 'suggested' ELSE 'discarded' END AS verdict
  FROM pp WHERE flag <> 'N'""")
def triage_proposals(spark, d):
    b = D.bullets(spark, d)
    first = b.groupBy(F.col("l_orderkey").alias("bullet_id")).agg(
        F.min_by(F.struct("text", "l_returnflag"), F.struct("l_linenumber", "text")).alias("s"))
    src = materialise(first.select("bullet_id", "s.text", "s.l_returnflag"))
    text = (F.when(F.col("l_returnflag") == "A", F.concat(F.regexp_replace("text", "^Led", "Ran"), F.lit(" ")))
            .when(F.col("l_returnflag") == "R", F.concat("text", F.lit(" as Chief"))).otherwise(F.col("text")))
    one = src.select("bullet_id", F.lit(1).alias("ord"), text.alias("proposal"), F.lit(" ok ").alias("why"))
    other = src.select((-F.col("bullet_id") - 1).alias("bullet_id"), F.lit(0).alias("ord"), F.lit("x").alias("proposal"), F.lit("").alias("why"))
    again = src.select("bullet_id", F.lit(2).alias("ord"), F.lit("Owned 99 things").alias("proposal"), F.lit("").alias("why"))
    return E.triage_proposals(one.unionByName(other).unionByName(again), src, VOCAB).select("bullet_id", "verdict")


@query("bullet_history", """WITH e AS (SELECT user_id AS bullet_id, event_id AS seq, ts, event_type FROM events WHERE event_type IN ('click', 'view', 'error')),
  r AS (SELECT bullet_id, max(seq) FILTER (WHERE event_type = 'error') AS lr FROM e GROUP BY 1),
  a AS (SELECT e.bullet_id, arg_max(event_type || seq, seq) AS text, arg_max(ts, seq) AS ts, count(*) AS n FROM e JOIN r USING (bullet_id)
    WHERE event_type <> 'error' AND (lr IS NULL OR seq > lr) GROUP BY 1)
  SELECT c_custkey AS bullet_id, coalesce(a.text, c_name) AS text, CASE WHEN a.text IS NOT NULL THEN c_name END AS original_text, a.ts AS accepted_at,
    coalesce(n, 0) AS accepts FROM customer LEFT JOIN a ON bullet_id = c_custkey""")
def bullet_history(spark, d):
    e = D.read(spark, d, "events").where(F.col("event_type").isin("click", "view", "error"))
    ev = e.select(F.col("user_id").alias("bullet_id"), F.col("event_id").alias("seq"), "ts",
                  F.when(F.col("event_type") == "error", "revert").otherwise("accept").alias("action"),
                  F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    b = D.read(spark, d, "customer").select(F.col("c_custkey").alias("bullet_id"), F.col("c_name").alias("text"))
    return E.bullet_history(ev, b)
