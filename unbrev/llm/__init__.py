"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this subpackage; it uses the library's general
helpers only.  ``unbrev.llm.queries`` has the registered queries and their SQL.
"""
