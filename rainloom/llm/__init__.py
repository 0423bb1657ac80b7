"""Operators for large training-text corpora: cleaning, deduplication, mixing, tokenising and sharding.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to
DataFrames; ``queries`` holds the thin registered queries and their SQL.
"""
