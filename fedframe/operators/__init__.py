"""Statements that change tables, and operators that Spark SQL lacks."""
