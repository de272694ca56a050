"""Operators of a training-data pipeline, and the queries that apply them to the given tables.

Nothing else in the package imports this one.  Python code of an operator runs on executors, so
the package has to be importable there (``--py-files`` or an image that holds it).
"""
