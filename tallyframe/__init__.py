"""Analytics operators for Spark DataFrames.

Subpackages
-----------
sources    reading, writing, snapshots, views, catalog reports
functions  column expressions (text, numbers, dates, arrays and maps)
operators  DataFrame-to-DataFrame operators
plans      the registered queries, each with its SQL counterpart
"""
