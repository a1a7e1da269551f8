"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; the rest of the library works
without it.  Each operator lives in a module of its own, ``queries`` holds the
registered ``opN_`` queries and their SQL.
"""
