"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns a DataFrame; :mod:`chronolith.llm.queries` wraps
them as the registered ``opN_*`` queries.
"""
