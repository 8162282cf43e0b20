"""Operators of a large-scale training-data pipeline over a ``documents``-like table.

Nothing outside this subpackage imports it; its registered queries and their SQL are in
:mod:`rollframe.llm.catalog`.
"""
