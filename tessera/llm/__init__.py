"""Operators for preparing training corpora.

Nothing outside this package imports it; the queries are in :mod:`tessera.llm.queries`.
"""
