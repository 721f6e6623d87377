"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames, tolerates extra columns, and is described in its own module.
"""
