"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` holds the thin queries and their SQL.
"""
