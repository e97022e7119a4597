"""Operators of a training-data pipeline, one module per operator.

Nothing else in ``rivulet`` imports this subpackage; it can be removed whole.
"""
