"""Operators of a training-data pipeline over documents, benchmark items and conversations.

Each operator module has a general interface and the thin ``opN_<name>`` query that
applies it to a whole input table; ``queries.py`` lists the queries and their SQL.
"""
