"""Operators of a training-data pipeline over `documents` and its sister tables.

Nothing outside this package imports it; `queries.py` registers its queries.
"""
