"""Operators for preparing language-model training text.

Nothing else in the package imports this subpackage; it can be removed as a
whole.  Every operator takes and returns DataFrames and keeps its own working
tables below the folder that the session names in ``spark.checkpoint.dir``.
"""
