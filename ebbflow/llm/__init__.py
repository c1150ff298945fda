"""Training-data pipeline operators.

Nothing outside this package imports it.  ``catalog.QUERIES`` and
``catalog.ORACLE`` hold the registered queries and their DuckDB statements.
"""
