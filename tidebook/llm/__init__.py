"""Operators for building training corpora: cleaning, deduplication, mixing, scoring and output.

Nothing outside this folder imports it.
"""
