"""Operators for preparing language-model training data.

One module per operator; ``queries.py`` registers the ``opN_`` queries.  No
other part of the library imports this subpackage.
"""
