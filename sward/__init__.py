"""sward — vegetation-survey analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver.  Layout:

* ``functions``  – column expressions with R semantics (rounding, NULL rules, strings)
* ``sources``    – typed CSV ingest / sinks, map layers, stand-in views on the driver tables
* ``operators``  – reshape, traits, fused metrics, biotope rules, change class, map queries, geo
* ``plans``      – the batch pipeline and the query catalogue (with DuckDB oracle SQL)
* ``streaming``  – the click → series query as a Structured Streaming job
"""

__version__ = "0.1.0"
