"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the queries built on it
are in :mod:`tallymart.llm.queries`.
"""
