"""Operators of a training-data pipeline: ten of them, each in a module of its own.

Nothing else in the library imports this subpackage. ``queries`` registers one query for each
operator; the operators keep general interfaces and return their real outputs.
"""
