"""Operators for preparing large text collections as training data.

Nothing outside this package imports it, so it can be removed as a whole.
"""
