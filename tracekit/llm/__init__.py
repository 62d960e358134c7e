"""Operators for preparing training data: language, duplicates, quality, licences and mixing.

Nothing outside this package imports it, so it can be removed without touching the rest.
"""
