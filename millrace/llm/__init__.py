"""Operators that prepare text for language-model training, one module each.

Nothing else in the library imports this subpackage.
"""
