"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage. Every operator takes and
returns DataFrames, reads only the columns it is told to read (extra columns
are ignored, whatever their names), and works on the whole input.
"""
