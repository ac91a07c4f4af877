"""Operators for training-data pipelines.

Nothing outside this folder imports it.  Every operator takes DataFrames and returns
DataFrames; the ``queries`` module holds the thin queries that apply them to the tables.
"""
