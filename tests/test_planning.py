"""Plans, page matching, options, gaps and the worklist's agreement with the kit."""

import pytest
from pyspark.sql import functions as F

from vacantia import schemas
from vacantia.operators import planning as P
from vacantia.operators import stats as A

L = F.lit


def arr(*xs):
    return F.array(*[L(x) for x in xs])


def opts(*xs):
    return F.array(*[F.struct(L(x).alias("label"), L(x.lower()).alias("value")) for x in xs])


@pytest.mark.parametrize("prefs,options,want", [
    (["Yes"], ["No", "Yes"], ("Yes", "exact")), (["yes"], ["No", "Yes, I am"], ("Yes, I am", "canonical")),
    (["True"], ["No", "Yes"], ("Yes", "synonym")), (["LinkedIn"], ["Via LinkedIn ads"], ("Via LinkedIn ads", "substring")),
    (["no"], ["Not applicable"], None), (["LinkedIn", "Referral"], ["Referral", "From linkedin ads"], ("From linkedin ads", "substring")),
    (["???"], ["?"], None), (["x"], [], None),
])
def test_match_option(one, prefs, options, want):
    o = opts(*options) if options else F.array().cast("array<struct<label:string,value:string>>")
    m = one(P.match_option(arr(*prefs), o))
    assert (None if m is None else (m.label, m.via)) == want


QS = [  # label, required, fields
    ("First Name", True, [("first", "short_text", None)]),
    ("Resume/CV", True, [("resume", "file", None), ("resume_text", "long_text", None)]),
    ("Cover Letter", False, [("cover", "file", None), ("cover_text", "long_text", None)]),
    ("Do you agree to the privacy policy?", True, [("pp", "single_select", ["Yes"])]),
    ("Will you require sponsorship?", True, [("sp", "single_select", ["Yes", "No"])]),
    ("How did you hear about us?", True, [("hear", "single_select", ["Referral", "LinkedIn"])]),
    ("Address line 2", False, [("a2", "short_text", None)]),
    ("Country", True, [("country", "single_select", ["India", "Peru"])]),
    ("If yes, explain", False, [("ify", "short_text", None)]),
    ("Shoe size", True, [("shoe", "single_select", ["41", "42"])]),
    ("Gender", False, [("g", "single_select", ["F", "M"])]),
    ("Humans only: why us", True, [("h", "long_text", None)]),
    ("Source", False, [("job_application[utm_source]", "unknown", None)]),
    ("A story", True, [("st", "long_text", None)]),
]


def tables(spark, resume="cv.pdf", bank=True):
    q = spark.createDataFrame(
        [("c", "p", i, lab, req, [(n, k, None if o is None else [(x, x) for x in o]) for n, k, o in fs]) for i, (lab, req, fs) in enumerate(QS)],
        f"candidate_id string, posting_id string, position int, label string, required boolean, fields {schemas.FIELDS}")
    prof = spark.createDataFrame([("c", "Ada", "Li", "a@b.c", "India", resume)],
                                 "candidate_id string, first_name string, last_name string, email string, country string, resume_name string")
    rows = [("c", 0, ["how did you hear about us"], [], None, ["LinkedIn job posting"], False, None),
            ("c", 1, [], ["sponsor"], None, ["Yes"], True, None)] if bank else []
    b = spark.createDataFrame(rows, "candidate_id string, ord int, label_keys array<string>, label_patterns array<string>, text string, "
                                    "option_preference array<string>, sensitive boolean, note string")
    return P.label_questions(q), prof, b


def test_compile_plan(spark):
    got = {r.label: (r.field_name, r.source, r.value) for r in P.compile_plan(*tables(spark)).collect()}
    assert got == {
        "First Name": ("first", "profile", "Ada"), "Resume/CV": ("resume", "file", "cv.pdf"),
        "Cover Letter": ("cover_text", "generated", None), "Do you agree to the privacy policy?": ("pp", "user", None),
        "Will you require sponsorship?": ("sp", "user", None), "How did you hear about us?": ("hear", "bank", "LinkedIn"),
        "Country": ("country", "profile", "India"), "If yes, explain": ("ify", "user", None), "Shoe size": ("shoe", "unresolved", None),
        "Gender": ("g", "user", None), "Humans only: why us": ("h", "user", None), "A story": ("st", "generated", None)}
    empty = P.compile_plan(*tables(spark, resume=None, bank=False))
    assert not {r.source for r in empty.collect()} & {"bank", "file"}
    assert empty.where("source is null").count() == 0
    assert P.executable(empty).first().executable is False


def test_run_and_kit_agree(spark):
    for resume in ("cv.pdf", None):
        q, prof, b = tables(spark, resume)
        a = P.compile_plan(q, prof, b)
        docs = prof.where("resume_name is not null").select("candidate_id", "resume_name")
        sizes = q.groupBy("posting_id").agg(F.count("*").alias("form_fields"))
        p = spark.createDataFrame([("c", "p", True, True), ("c", "u", None, None), ("c", "n", True, False)],
                                  "candidate_id string, posting_id string, f boolean, form_readable boolean").select(
            "candidate_id", "posting_id", F.when(F.col("f"), F.current_timestamp()).alias("form_fetched_at"), "form_readable")
        run = {r.posting_id: r for r in P.run_row(p, a, sizes, docs).collect()}
        k = P.kit(a, docs, sizes).first()
        assert (run["p"].prepared, run["p"].yours, run["p"].open) == (k.prepared, k.yours, k.open) == (len(k.answers), len(k.your_answers), len(k.open_items))
        assert run["u"].prepared is None and run["u"].reason == "form not read yet" and run["n"].reason == "no readable form"
        assert ("Resume/CV" in [x.label for x in k.open_items]) is (resume is None)


def test_match_plan_to_page(spark):
    acts = spark.createDataFrame([
        ("f", 1, "first", "First name", "profile", "Ada", True), ("f", 2, "first", "Again", "profile", "Bo", True),
        ("f", 3, "gone", "E-mail (optional)", "profile", "a@b", False), ("f", 4, "sel", "Pick", "bank", "yes!", True),
        ("f", 5, "sel2", "Pick two", "bank", "maybe", True), ("f", 6, "x", "Mine", "user", None, True),
        ("f", 7, "none", "Nowhere", "profile", "v", True), ("f", 8, "first2", "Blank", "profile", "", True)],
        "form_id string, ord int, field_name string, label string, source string, value string, required boolean")
    flds = spark.createDataFrame([
        ("f", 1, "h1", "first", None, "x", "text", None), ("f", 2, "h2", None, None, "E-mail *", "text", None),
        ("f", 3, "h3", None, "sel", None, "select", ["No", "Yes"]), ("f", 4, "h4", "sel2", None, None, "select", ["A"]),
        ("f", 5, "h5", None, None, "Extra consent", "checkbox", None), ("f", 6, "h6", None, None, None, "unknown", None)],
        "form_id string, ord int, handle string, name string, id string, label string, kind string, options array<string>")
    m, u = P.match_plan_to_page(acts, flds)
    got = {r.ord: (r.outcome, r.handle, r.value, r.via) for r in m.collect()}
    assert got == {1: ("fill", "h1", "Ada", "name"), 2: ("unmatched", None, None, None), 3: ("fill", "h2", "a@b", "label"),
                   4: ("fill", "h3", "Yes", "id"), 5: ("skipped", None, None, None), 6: ("skipped", None, None, None),
                   7: ("unmatched", None, None, None), 8: ("skipped", None, None, None)}
    assert sorted(r.handle for r in u.collect()) == ["h4", "h5"]


def test_reuse_curve_and_patterns(spark):
    q = spark.createDataFrame([(k,) for k, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1)) for _ in range(n)], "label_key string")
    r = A.reuse_curve(q).first()
    assert (r.instances, r.unique_keys, r.keys_for_half) == (12, 4, 2)
    b = spark.createDataFrame([("c", 0, ["ok", "(["])], "candidate_id string, ord int, label_patterns array<string>")
    assert A.screen_patterns(b).first().label_patterns == ["ok"]
