"""Vacantia: postings, form questions and candidate matching as Spark jobs."""
