"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and ``__spark_entry__.py`` adds them when it is present.
"""
