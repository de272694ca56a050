"""The registry, and a cross-section of queries against their SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from vacantia import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SAMPLE = ("extract_facts", "flatten_form", "close_delisted", "search_postings", "match_score", "compile_plan", "match_plan_to_page",
          "gap_report", "tailor_bullets", "analyse_resume", "resume_roles", "stream_application_state")


def test_registry():
    q, o = catalog.queries(), catalog.oracles()
    assert len(q) >= 140 and set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_queries import rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    res = con.execute(catalog.oracles()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in res.description], res.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_gap_report_in_full(spark):
    """The three parts equal their SQL, and together give every row of every candidate."""
    duckdb = pytest.importorskip("duckdb")
    from tools.check_queries import rows_of
    from vacantia.catalog import tables as D
    from vacantia.operators import stats as A

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = {}
    for name in ("gap_report_corpus", "gap_report_answered", "gap_report_totals"):
        df = catalog.queries()[name](spark, SF)
        res = con.execute(catalog.oracles()[name])
        got[name] = df.collect()
        assert rows_of(df.columns, [tuple(r) for r in got[name]]) == rows_of([c[0] for c in res.description], res.fetchall()), name
    corpus = A.corpus_gaps(D.questions(spark, SF))
    listed = A.gap_report(corpus, D.candidates(spark, SF, with_skills=False), A.corpus_answers(corpus, D.bank(spark, SF)), len(got["gap_report_corpus"]))
    want = {(r.candidate_id, r.kind, r.label_key, r.label, r.n_instances, r.required_count, r.profile_field) for r in listed.collect()}
    known = {(r.candidate_id, r.kind, r.label_key or r.profile_field) for r in got["gap_report_answered"]}
    open_rows = {(t.candidate_id, r.kind, r.label_key, r.label, r.n_instances, r.required_count, r.profile_field)
                 for t in got["gap_report_totals"] for r in got["gap_report_corpus"]
                 if (t.candidate_id, r.kind, r.profile_field if r.kind == "profile" else r.label_key) not in known}
    assert open_rows == want and any(k == "bankable" for _, k, _ in known)
    assert max(Counter((x[0], x[1]) for x in want).values()) > 5  # more than the display list has
