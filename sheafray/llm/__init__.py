"""Operators for preparing training data, one module per operator.

Nothing outside this sub-package imports it.
"""
