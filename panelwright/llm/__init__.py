"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Each operator is one module with a
general interface; ``catalog`` registers a thin query for each.
"""
