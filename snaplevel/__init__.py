"""Completeness scoring and snapshot comparison for very large record collections, on Spark.

Everything is DataFrame in, DataFrame out; nothing here starts a session or changes its settings.
"""
