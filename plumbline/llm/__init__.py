"""Operators of a training-data pipeline: counting, scanning, scoring, encoding, de-duplicating and mixing documents.

Nothing else in the library imports this package.
"""
