"""Operators of a training-data pipeline: quality, privacy, duplicates, mixing.

Nothing outside this subpackage imports it.
"""
