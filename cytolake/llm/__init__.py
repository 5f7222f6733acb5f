"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Queries and their SQL are
gathered in :mod:`cytolake.llm.registry`.
"""
