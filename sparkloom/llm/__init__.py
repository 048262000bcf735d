"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it; remove it and the rest still works.
"""
