"""Operators over DataFrames: scans, projections, joins, and primitives on row ids and hash buckets."""
