"""Operators for preparing large text corpora, all on Spark DataFrames.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
registered queries.
"""
