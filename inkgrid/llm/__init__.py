"""Operators for training-data corpora: extraction, filters, tokenizing, deduplication, scoring.

Nothing outside this folder imports it. A module holds one operator; ``registry`` holds the queries.
"""
