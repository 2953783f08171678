"""Operators for large training-data pipelines.

Each module holds one operator: a function from DataFrame to DataFrame.  ``queries.py`` has the
registered query of each operator.  Nothing outside this package imports it.
"""
