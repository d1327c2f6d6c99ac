"""Training-data operators: search, deduplication, classifiers, archives, packing.

Nothing else in the library imports this package.  ``queries.py`` holds the
registered queries and their DuckDB oracles.
"""
