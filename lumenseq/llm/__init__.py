"""Operators for preparing language-model training data at scale.

Each module holds one operator with a general interface; `queries` holds the thin registered
queries. All operators read only the columns that they name, so extra columns never clash.
"""
