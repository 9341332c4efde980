"""Operators for training-data pipelines: search, counting, sharding, de-duplication, quality, packing, mixing and scans.

Nothing outside this subpackage imports it.
"""
