"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the queries it registers are in
:mod:`lattica.llm.queries`.
"""
