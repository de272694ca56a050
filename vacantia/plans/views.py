"""Whole flows put together from the operators: one DataFrame plan each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.operators import index as X
from vacantia.operators import planning as P
from vacantia.operators import matching as M
from vacantia.operators import requests as R
from vacantia.operators import score as W
from vacantia.operators import search as S
from vacantia.session import materialise


def ingest(listings: DataFrame, target: DataFrame, board_status: DataFrame, now: Column,
           vocab: Iterable[str]) -> DataFrame:
    """Landed listings to the next state of the postings table: facts, upsert, closing."""
    facts = X.extract_facts(listings, vocab)
    return X.close_delisted(X.upsert_postings(target, facts, now), facts, board_status, now)


def best_postings(profiles: DataFrame, postings: DataFrame, boards: DataFrame, k: int,
                  scopes: DataFrame | None = None, world: Iterable[str] = V.WORLD_COUNTRIES) -> DataFrame:
    """The posting list of every candidate: visible, eligible, best fit first."""
    spark = postings.sparkSession
    p = profiles.withColumn("candidate_country", S.country_of_profile("country", "location"))
    countries = p.select(F.col("candidate_country").alias("country"))
    rules = S.country_rules(countries, scopes if scopes is not None else S.scope_table(spark), world)
    return M.top_matches(p, S.visible_postings(postings, boards), k, rules)


def answer_conversations(messages: DataFrame, postings: DataFrame, now: Column, k: int,
                         vocab: Iterable[str], rules: DataFrame | None = None) -> DataFrame:
    """Requests of conversations to the newest matching postings per turn.

    ``messages``: conv_id, turn, msg_id, text, candidate_country.  The parsed turns
    are stored once, because the fold reads them several times.
    """
    parsed = materialise(R.parse_requests(messages, S.distinct_companies(postings), vocab))
    folded = R.fold_conversation(parsed)
    asked = folded.join(messages.select("conv_id", "turn", "msg_id", "candidate_country"), ["conv_id", "turn"])
    searches = asked.select(F.col("msg_id").alias("search_id"), "candidate_country", "f")
    hits = S.search(postings, searches, now, rules)
    order = [F.col("posted_at").desc_nulls_last(), F.col("posting_id")]
    return W.top_k(hits, k, keys=("search_id",), order=order)


def worklist(ranked: DataFrame, applications: DataFrame, questions: DataFrame, profiles: DataFrame,
             bank: DataFrame, k: int) -> DataFrame:
    """The next ``k`` postings per candidate with the counts of their prepared forms.

    ``ranked`` carries the form columns of its postings; forms are planned for the
    chosen postings only.
    """
    chosen = P.worklist(ranked, applications, k)
    asked = questions.drop("candidate_id").join(chosen.select("candidate_id", "posting_id"), "posting_id")
    actions = P.compile_plan(asked, profiles, bank)
    sizes = questions.groupBy("posting_id").agg(F.count("*").alias("form_fields"))
    documents = profiles.where(F.col("resume_name").isNotNull()).select("candidate_id")
    return P.run_row(chosen, actions, sizes, documents)
