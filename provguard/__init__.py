"""provguard: provider-exclusion and claims analytics on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` expressions, so Catalyst sees the whole plan
(pruning, pushdown, partial aggregation, broadcast choice) and nothing runs
row-by-row in Python.
"""

__version__ = "0.1.0"
