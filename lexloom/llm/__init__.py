"""Operators for training-data pipelines over large document tables.

Nothing outside this package imports it.  ``queries.queries()`` and
``queries.oracle_sql()`` are what the driver contract adds to its own.
"""
