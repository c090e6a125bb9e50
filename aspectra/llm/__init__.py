"""Operators of a training-data pipeline: de-duplication, filtering, scans, sharding, packing.

Nothing else in the library imports this subpackage; ``queries`` holds its
registered queries and their SQL.
"""
