"""Operators for preparing language-model training data, as DataFrame transformations.

Nothing outside this subpackage imports it.
"""
