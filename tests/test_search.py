"""Eligibility, search, requests and saved searches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia import schemas
from vacantia.functions import text as T
from vacantia.operators import requests as R
from vacantia.operators import search as S



def now():
    return F.lit("2026-09-01").cast("timestamp")


POSTING = ("posting_id string, title string, company string, location string, country string, remote boolean, remote_scope string, "
           "workplace string, level string, skills array<string>, posted_at timestamp, first_seen_at timestamp")
D1, D2 = dt.datetime(2026, 8, 30), dt.datetime(2026, 1, 1)
POSTINGS = [
    ("p1", "Senior Data Engineer", "Acme", "London, UK", "United Kingdom", False, None, "onsite", "senior", ["python", "sql"], D1, D1),
    ("p2", "Engineer, Data and AI", "Acme", "Bengaluru", "India", False, None, None, None, ["python"], D2, D2),
    ("p3", "Database Engineer", "Beta", None, None, True, "US", "remote", None, ["sql"], D1, D2),
    ("p4", "Data Engineering Lead", "Beta", "Remote - Poland", None, True, None, "remote", "staff", [], D1, D1),
    ("p5", "Chef", "Gamma", "Kochi, India", "India", False, None, "hybrid", None, None, None, D1),
]


def filt(**kw):
    base = dict(company=None, days=None, level=None, place=None, skills=[], words=[], workplace=None)
    return base | kw


def searches(spark, rows):
    return spark.createDataFrame([(i, c, f, D2) for i, c, f in rows],
                                 f"search_id string, candidate_country string, f {schemas.FILTERS}, last_seen_at timestamp")


def rules(spark, *countries):
    c = spark.createDataFrame([(x,) for x in countries], "country string")
    return S.country_rules(c, S.scope_table(spark), V.WORLD_COUNTRIES)


@pytest.mark.parametrize("candidate,remote,scope,location,country,keep", [
    ("india", True, None, "Anywhere", None, True), ("india", True, "US", "Remote", None, False),
    ("india", True, "EMEA", "Remote", None, True), ("india", False, "US", "Bangalore", "India", True),
    ("india", False, None, "Austin", "United States", False), ("india", False, None, "?", None, True),
    ("india", True, None, "Poland", None, False), ("india", True, None, "remote - united states", None, False),
    ("india", True, None, "United States or Remote (Global)", None, True), ("india", True, None, None, None, True),
    ("united states", False, None, "x", "USA", True), ("australia", True, "US", "Remote", None, False),
    ("australia", True, "AUSTRALIA", "Remote", None, True), (None, True, "US", "Remote", "India", True),
    ("poland", True, None, "Poland", None, True),
])
def test_eligible(spark, candidate, remote, scope, location, country, keep):
    df = spark.createDataFrame([(candidate, remote, scope, location, country)],
                               "candidate_country string, remote boolean, remote_scope string, location string, posting_country string")
    assert (S.eligible(df, rules(spark, "india", "united states", "australia", "poland")).count() == 1) is keep


def brute_search(f, rows):
    """Every posting against one filter, in plain Python."""
    import re

    def word(t, w):
        return re.search(rf"(^|[^a-z0-9]){re.escape(w)}(s|es|ing)?($|[^a-z0-9])", t.lower())

    hits = []
    for r in rows:
        pid, title, company, loc, country, remote, _, work, level, skills, posted, _ = r
        ok = all(s in (skills or []) for s in f["skills"])
        if f["place"]:
            c = {p[0]: p[3] for p in V.REQUEST_PLACES}.get(f["place"]["label"])
            ok &= any(t in (loc or "").lower() for t in f["place"]["terms"]) or (c is not None and country == c)
        if f["workplace"]:
            ok &= work == f["workplace"] or (f["workplace"] == "remote" and remote)
        ok &= f["level"] in (None, level) and f["company"] in (None, company)
        if f["days"]:
            ok &= posted is not None and posted >= dt.datetime(2026, 9, 1) - dt.timedelta(days=f["days"])
        if ok and all(word(title, w) for w in f["words"]):
            body = r"[\s/-]+".join(re.escape(w) + "(s|es|ing)?" for w in f["words"])
            phrase = len(f["words"]) < 2 or bool(re.search(rf"(^|[^a-z0-9]){body}($|[^a-z0-9])", title.lower()))
            hits.append((pid, phrase))
    if any(p for _, p in hits):
        hits = [h for h in hits if h[1]]
    return sorted(p for p, _ in hits)


FILTERS = {
    "phrase": filt(words=["data", "engineer"]), "loose": filt(words=["engineer", "ai"]), "one": filt(words=["engineer"]),
    "skill": filt(skills=["python", "sql"]), "place": filt(place={"label": "India", "terms": ["india"]}),
    "city": filt(place={"label": "London", "terms": ["london"]}, words=["data"]), "remote": filt(workplace="remote"),
    "level": filt(level="senior"), "company": filt(company="Beta", workplace="remote"), "days": filt(days=7), "all": filt(),
    "mixed": filt(words=["data"], days=7, level="staff"), "none": filt(words=["pilot"]),
}


def test_search_equals_brute_force(spark):
    p = spark.createDataFrame(POSTINGS, POSTING)
    s = searches(spark, [(k, None, f) for k, f in FILTERS.items()])
    got = {}
    for r in S.search(p, s, now()).collect():
        got.setdefault(r.search_id, []).append(r.posting_id)
    for k, f in FILTERS.items():
        assert sorted(got.get(k, [])) == brute_search(f, POSTINGS), k


def test_search_eligibility_yields_to_a_named_place(spark):
    p = spark.createDataFrame(POSTINGS, POSTING)
    s = searches(spark, [("a", "india", filt(words=["data"])), ("b", "india", filt(words=["data"], place={"label": "London", "terms": ["london"]}))])
    got = sorted((r.search_id, r.posting_id) for r in S.search(p, s, now(), rules(spark, "india")).collect())
    assert got == [("a", "p2"), ("b", "p1")]


def test_counts_and_loosen(spark):
    p = spark.createDataFrame(POSTINGS, POSTING)
    s = searches(spark, [("x", None, filt(words=["data"], level="intern")), ("y", None, filt(words=["pilot"])), ("z", None, filt(company="Beta"))])
    bad = spark.createDataFrame([("w", None, None, D2)], s.schema)
    counts = {r.search_id: (r.total, r.new_count, r.broken) for r in S.saved_search_counts(s.unionByName(bad), p, now()).collect()}
    assert counts == {"x": (0, 0, False), "y": (0, 0, False), "z": (2, 1, False), "w": (0, 0, True)}
    best = {r.search_id: (r.key, r.total) for r in S.loosen(p, s.where("search_id <> 'z'"), now()).collect()}
    assert best == {"x": ("level", 3), "y": ("words", 5)}


SKILLS = ("python", "sql", "node.js", "react", "react native")


def parse(spark, text, companies=("Gusto, Inc.", "Stripe Labs", "Stripe")):
    c = spark.createDataFrame([(x,) for x in companies], "company string")
    m = spark.createDataFrame([("m", text)], "msg_id string, text string")
    return R.parse_requests(m, c, SKILLS).first()


@pytest.mark.parametrize("text,want", [
    ("senior data engineer jobs in bangalore at Gusto", dict(words=["data", "engineer"], level="senior", place="Bengaluru", company="Gusto, Inc.")),
    ("jobs in new delhi", dict(place="Delhi NCR", words=None)), ("work at stripe labs please", dict(company="Stripe Labs", words=None)),
    ("remote python roles from the last 400 days", dict(workplace="remote", skills=["python"], days=365)),
    ("node.js and react native this week", dict(skills=["node.js", "react native"], days=7, words=None)),
    ("please show me some jobs", dict(words=None, place=None)),
    ("designer with visa sponsorship and good pay", dict(words=["designer"], notes=["visa", "pay"])),
    ("ops in indiana", dict(place=None, words=["ops", "indiana"])),
])
def test_parse_requests(spark, text, want):
    r = parse(spark, text)
    for k, v in want.items():
        got = r.place.label if k == "place" and r.place else r[k]
        assert got == v, (k, got)


def test_fold_conversation(spark):
    turns = ["senior data engineer in london", "only this week", "with python", "and sql", "product manager",
             "data analyst jobs in india", "please show me some jobs", "start over", "hybrid"]
    m = spark.createDataFrame([("c", i, f"c-{i}", t) for i, t in enumerate(turns)], "conv_id string, turn bigint, msg_id string, text string")
    parsed = R.parse_requests(m, None, SKILLS)
    for chunk in (2, 100):
        f = {r.turn: r for r in R.fold_conversation(parsed, chunk=chunk).collect()}
        assert f[1].f.words == ["data", "engineer"] and f[1].f.days == 7 and f[1].f.level == "senior" and not f[1].reset
        assert f[3].f.skills == ["python", "sql"]
        assert f[4].f.words == ["product", "manager"] and f[4].f.place.label == "London"
        assert f[5].reset and f[5].f.level is None and f[5].f.place.label == "India" and f[5].f.skills == []
        assert f[6].unchanged and not f[6].reset
        assert f[7].reset and f[7].f.words == [] and f[7].f.place is None
        assert f[8].f.workplace == "hybrid" and not f[8].unchanged


def test_canonical_and_save(spark):
    a = '{"words":["x"],"level":"senior","skills":["a","b"]}'
    b = '{"skills":["a","b"],"level":"senior","words":["x"]}'
    c = '{"skills":["b","a"],"level":"senior","words":["x"]}'
    df = spark.createDataFrame([(1, a, 1), (2, b, 2), (3, c, 3)], "search_id int, js string, t int").select(
        F.lit("k").alias("candidate_id"), "search_id", F.lit("l").alias("label"),
        F.from_json("js", schemas.FILTERS).alias("f"), F.timestamp_seconds("t").alias("created_at"))
    assert df.select(T.canonical_json("f").alias("c")).distinct().count() == 2
    assert sorted(r.search_id for r in S.save_searches(df).collect()) == [1, 3]


def test_chips_agree_with_without_part(spark):
    s = searches(spark, [("m", None, filt(words=["a", "b"], skills=["x", "y"], days=1, level="mid"))])
    keys = [r.key for r in s.select(F.explode(S.chips()).alias("c")).select("c.key").collect()]
    assert keys == ["words", "skill:x", "skill:y", "level", "days"]
    for k in keys:
        left = s.withColumn("f", S.without_part(F.lit(k))).select(F.explode(S.chips()).alias("c")).select("c.key").collect()
        assert [r.key for r in left] == [x for x in keys if x != k]


def test_literal_pieces_only_spare_searches(spark):
    rules = [p for g in (V.REQUEST_LEVELS, V.REQUEST_WORKPLACES, V.REQUEST_DAYS, V.REQUEST_CANNOT) for _, p in g] + [V.REQUEST_RESET]
    assert all(R.literals(p) for p in rules)
    assert R.literals(r"\b(colou?r|in[- ]office|clear (it|this)?)\b") == ["colo", "office", "clear "]
    for unknown in (V.REQUEST_REFINE, r"\b(a\.b)\b", r"\b(x|[ab])\b", r"\b(a{2}b)\b", r"\b((?i)abc)\b", r"\b(a)|(b)\b", r"\b([(]a|b)\b"):
        assert R.literals(unknown) is None
    texts = ["clear", "clear it", "x clear  day", "on site", "onsite", "on-sites", "in office", "midlevel", "mid level", "sr.", "srx", "é sr", "pays", "last 24 hours", "forget that", ""]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for p in rules:
        assert df.where(~R._found(F.col("t"), p).eqNullSafe(F.col("t").rlike(R._ascii(p)))).count() == 0
    ends = [" remote ", "remote  ", "   pune’s jobs\n\n", " ", "remote"]
    m = spark.createDataFrame([(str(i), t) for i, t in enumerate(ends)], "msg_id string, text string")
    plain = F.lower(T.squeeze(F.regexp_replace("text", "[’']", "'")))
    assert [r.words for r in R.parse_requests(m, None, []).collect()] == [r.words for r in R.parse_requests(m.withColumn("text", plain), None, []).collect()]
