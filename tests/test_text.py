"""Truth tables for the text functions."""

import pytest
from pyspark.sql import functions as F

from vacantia.functions import text as T

L = F.lit
VOCAB = ["python", "node.js", "node", ".net", "c++", "react", "react native", "docker", "sound design",
         "design system", "design", "forecasting", "forecasting"]


@pytest.mark.parametrize("html,text", [
    ("&lt;p&gt;Hi&lt;/p&gt;", "Hi"),
    ("a&amp;#39;s &#8217;x &#38;#39;", "a's ’x &#39;"),
    ("a&nbsp;b&rsquo;c&quot;", "a b’c\""),
    ("x<style>p{}</style><SCRIPT>y</SCRIPT>z", "x z"),
    ("<ul><li>One</li><li class='a'>Two</li></ul>", "• One \n• Two"),
    ("a<br/>b<br >c</p>\n\n\n\nd", "a\nb\nc\n\nd"),
    ("&#99999999999999999999;", "&#99999999999999999999;".replace("&#99999999999999999999;", "")),
])
def test_html_to_text(one, html, text):
    assert one(T.html_to_text(L(html))) == text


@pytest.mark.parametrize("text,terms", [
    ("Python. Docker. Node.", ["docker", "node", "python"]),
    ("we use node.js here", ["node.js"]),
    ("C++. and .NET.", [".net", "c++"]),
    ("react native beats react", ["react", "react native"]),
    ("react native only", ["react native"]),
    ("sound design system", ["design system"]),
    ("sound design systems", ["sound design"]),
    ("forecasting forecasting", ["forecasting"]),
    ("pythonic", []), ("x.python", []), ("", []),
])
def test_terms_in(one, text, terms):
    assert one(T.terms_in(L(text), VOCAB)) == terms


def claim_longest_first(text, vocab):
    """Brute force: terms claim spans longest first, every span of a term is blanked."""
    import re
    text, found = text.lower(), []
    for t in sorted(dict.fromkeys(vocab), key=lambda x: -len(x)):
        pat = re.compile(rf"(?<![a-z0-9+#./]){re.escape(t)}(?![a-z0-9+#/]|\.[a-z0-9+#/])")
        if pat.search(text):
            found.append(t)
            text = pat.sub("~" * len(t), text)
    return sorted(found)


def test_terms_in_equals_longest_first_claims(spark):
    import itertools
    words = ["sound", "design", "system", "admin", "c++", "x", "ops"]
    vocab = ["sound design", "design system", "system admin ops", "admin ops", "design", "system", "ops x", "sound", "c++"]
    texts = [" ".join(p) for p in itertools.product(words, repeat=4)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.terms_in("t", vocab).alias("r")).collect()
    bad = [(r.t, r.r, claim_longest_first(r.t, vocab)) for r in got if r.r != claim_longest_first(r.t, vocab)]
    assert not bad, bad[:5]


def test_terms_from_a_table_equal_claims(spark):
    import random

    from vacantia.operators import vocabulary as L

    r = random.Random(4)
    vocab = sorted(["sound design", "design system", "system admin ops", "admin ops", "design", "system", "ops x", "sound", "c++", ".net", "node.js", "inc.", "a/b testing", "r&d", "r", *VOCAB])
    words = ["Sound", "design", "system", "admin", "c++", "x", "ops", ".NET", "node.js", "node", "inc.", "a/b", "testing", "r&d", "r", "..net", "c++.", "(react)", "native,", "-", "\n", "é"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(1500)] + ["", "design " * 5000, "..."] + ["sound design system admin ops x"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, t string")
    many = spark.createDataFrame([(t,) for t in [*vocab, "", None, *(f"term {k} of many" for k in range(10_000))]], "term string")
    got = {x.id: x.terms for x in L.with_terms(df, L.vocabulary(many), "id", "t").collect()}
    assert got.pop(-1) is None and len(got) == len(texts)
    bad = [(t, got[i], claim_longest_first(t, vocab)) for i, t in enumerate(texts) if got[i] != claim_longest_first(t, vocab)]
    assert not bad, bad[:5]


@pytest.mark.parametrize("title,body,level,workplace", [
    ("Data Analyst (Hybrid)", "remote team", None, "hybrid"),
    ("Senior Engineer", "fully remote, hybrid culture", "senior", "remote"),
    ("Intern", "hybrid, some remote", "intern", "hybrid"),
    ("Staff Engineer", "remote", "staff", "remote"),
    ("Head of Ops", "work on-site", "manager", "onsite"),
    ("Jr. Editor", "", "junior", None),
])
def test_level_and_workplace(one, title, body, level, workplace):
    assert one(T.level_of(L(title)), T.workplace_of(L(title), L(body))) == (level, workplace)


@pytest.mark.parametrize("text,years", [
    ("3-5 years experience", 3), ("3 – 5 years of experience", 3), ("founded 10 years ago", None),
    ("experience of 4+ years", 4), ("100 years experience", None), ("45 years experience\n6 years background", 6),
    ("3 years of runway\n7 to 9 years working with data", 7), ("industry tenure: 2 years", 2),
])
def test_required_years(one, text, years):
    assert one(T.required_years(L(text))) == years


@pytest.mark.parametrize("loc,body,scope", [
    ("Remote - US", "", "US"), ("Remote (EMEA)", "", "EMEA"), ("Berlin", "remote within the united kingdom", "UK"),
    ("", "us-only", "US"), ("Remote", "anywhere", None), ("Remote - usability", "", None),
])
def test_remote_scope(one, loc, body, scope):
    assert one(T.remote_scope_of(L(loc), L(body))) == scope


def test_country(one):
    assert one(T.country_of(L("Bangalore, IN")), T.country_of(L("München")), T.country_of(L("Nowhere"))) == ("India", "Germany", None)


@pytest.mark.parametrize("text,section,found", [
    ("About\nRequirements:\n- a\n• good skills\nBenefits\nx", "- a\n• good skills", True),
    ("• skills\nno heading here.", "", False), ("Skills\n\nlast", "last", True),
    ("We look for people with many different skills and much more than that indeed\nx", "", False),
])
def test_requirements_section(one, text, section, found):
    r = one(T.requirements_section(L(text)))
    assert (r.section, r.found) == (section, found)


def test_requirements_are_whole(one):
    assert len(one(T.requirements_section(L("Skills\n" + "x" * 4000))).section) == 4000
    section = T.requirements_section(L("Skills\n" + "filler words here\n" * 400 + "python"))["section"]
    assert one(T.terms_in(section, ["python"])) == ["python"]


@pytest.mark.parametrize("label,kinds,key,cls,human", [
    ("Please tell us (optional) why *", ["short_text"], "tell us why", "generated", False),
    ("Cover Letter", ["file", "long_text"], "cover letter", "generated", False),
    ("Resume/CV", ["file"], "resume/cv", "file", False),
    ("“First” Name: https://x.y/z &amp; <b>", ["short_text"], "first name", "profile", False),
    ("Anything you built", ["long_text"], "anything you built", "generated", False),
    ("Privacy policy", ["single_select"], "privacy policy", "bank", True),
    ("May we record this interview?", ["single_select"], "may we record this interview", "bank", True),
    ("Export control statement", ["single_select"], "export control statement", "bank", True),
    ("Gender", ["single_select"], "gender", "demographic", False),
])
def test_labels(one, label, kinds, key, cls, human):
    k = T.normalise_label(L(label))
    got = one(k, T.classify_question(k, F.array(*[L(x) for x in kinds])), T.human_only(k))
    assert got == (key, cls, human)


@pytest.mark.parametrize("key,field", [
    ("preferred first name", "preferred_first_name"), ("full name", "full_name"), ("address line 2", "address_line2"),
    ("which state or province do you currently live in", "state"), ("what is the zip code of your home", "postal_code"),
    ("select the country you anticipate working from", None), ("preferred last name", "last_name"), ("notice period", None),
])
def test_profile_field(one, key, field):
    assert one(T.profile_field_for(L(key))) == field


@pytest.mark.parametrize("url,ref", [
    ("https://boards.greenhouse.io/acme/jobs/12?gh_jid=9", ("acme", "12")),
    ("https://job-boards.greenhouse.io/acme/jobs/12/application", ("acme", "12")),
    ("https://boards.greenhouse.io/embed/job_app?for=acme&token=7", ("acme", "7")),
    ("https://boards.greenhouse.io/acme?gh_jid=5", ("acme", "5")),
    ("https://boards.greenhouse.io/acme", None), ("https://boards.greenhouse.io.evil.com/acme/jobs/1", None), ("not a url", None),
])
def test_posting_ref(one, url, ref):
    r = one(T.posting_ref(L(url)))
    assert (tuple(r) if r else None) == ref


def test_titles(one):
    w = lambda *x: F.array(*[L(i) for i in x])
    assert one(T.title_matches(L("Database Engineer"), w("data", "engineer"))) is False
    assert one(T.title_matches(L("Engineering of Data"), w("data", "engineer"))) is True
    assert one(T.title_has_phrase(L("Data-Engineers lead"), w("data", "engineer"))) is True
    assert one(T.title_has_phrase(L("Engineer, Data"), w("data", "engineer"))) is False
    assert one(T.title_matches(L("C++ Developer"), w("c++"))) is True


def test_claims(one):
    n, c, p = one(T.numbers_in(L("Two teams, 1,000.00 rows, 40% and 3x in 3")), T.credit_groups_in(L("Led and owned the best")),
                  T.proper_nouns_in(L("Built Spark at Acme. Then moved. I used Kafka")))
    assert n == ["2", "1000", "40%", "3x", "3"] and c == ["lead", "own", "superlative"]
    assert p == ["Spark", "Acme.", "Kafka"]


def test_small_ones(one):
    assert one(T.company_key(L("Gusto, Inc."))) == "gusto"
    assert one(T.names_employer(L("Worked at Acme before?"), L("a ACME Ltd"))) is True
    assert one(T.names_employer(L("Worked here?"), L("X"))) is False
    assert one(T.employer_name(L("big-co_labs"))) == "Big Co Labs"
    assert one(T.canon_option(L("Yes, I am (really)"))) == "yes"
    assert one(T.days_old(L(None).cast("timestamp"), F.current_timestamp())) is None


def test_a_scope_is_searched_for_once(spark):
    rows = spark.createDataFrame([("Berlin", "Remote - UK only"), (None, "wfh in the United States"), ("Remote, India", None), ("x", "y")], "l string, t string")
    out = rows.select(T.remote_scope_of("l", "t").alias("s"))
    assert [r.s for r in out.collect()] == ["UK", "US", "INDIA", None]
    plan = rows.selectExpr("l || '' AS l", "concat(t, '') AS t").select(T.remote_scope_of("l", "t").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("remote|wfh") == 2  # its two groups; one look-up per label repeated them


def test_white_space_and_years_as_before(one):
    assert one(T.trim_ws(F.lit("  a\t b \n")), T.trim_ws(F.lit(" \n ")), T.trim_ws(F.lit("a  "))) == ("a\t b", "", "a ")
    assert one(T.html_to_text(F.lit("<p>a \t b  c</p>\td&#8217;s &amp;#65; &#x"))) == "a b c\n d’s A &#x"
    assert one(T.required_years(F.lit("1 2 30 years, experience of 4+ years")), T.required_years(F.lit("12 kinds, 3 to 5 years working"))) == (2, 3)
