"""Operators that prepare text corpora for language-model training.

Nothing outside this folder imports it; see ``queries.py`` for the registered queries.
"""
