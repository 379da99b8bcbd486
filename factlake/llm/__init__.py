"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the
registered queries are in :mod:`factlake.llm.queries`.
"""
