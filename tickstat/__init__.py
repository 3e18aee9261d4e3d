"""tickstat: market-microstructure analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark's own
functions. Operators never create or stop a session, never print and never
collect data rows; the few that need a scalar (a quantile threshold) fetch a
single bounded value.
"""

__version__ = "0.1.0"
