"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the queries of its operators are in ``queries``.
"""
