"""Operators for training data: pairs, set joins, canonical lists, encoding, mixing, quality.

Nothing outside this subpackage imports it.
"""
