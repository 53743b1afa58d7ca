"""Operators of a training-data pipeline, one module each, over tables of documents.

Nothing outside this folder imports it.  ``queries.QUERIES`` and ``queries.ORACLES`` are what the
entry module registers.
"""
