"""Operators for large training-data pipelines.

Nothing outside this folder imports it; its queries and their SQL are in
``tagflow.llm.queries``.
"""
