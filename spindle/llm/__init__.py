"""Operators that prepare language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the thin
queries and their SQL.
"""
