"""Operators for building training corpora, and their registered queries.

Nothing else in the library imports this subpackage.
"""
