"""Supplier-invoice analytics on Spark DataFrames.

Every operator takes and returns DataFrames. Nothing reads the clock (callers
pass ``as_of``) and every generated id is a hash of the natural key, so a
recomputed partition always produces the same rows.
"""
