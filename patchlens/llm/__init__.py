"""Operators of a training-data pipeline over a `documents` table.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
