"""Operators for training-data corpora: scoring, dedup, scanning, mixing, sharding.

Nothing outside this subpackage imports it.
"""
