"""factorlab: collaborative-filtering analytics on Spark DataFrames.

Sub-packages
------------
sources    readers for rating/item/user/play/alias text files and the views
           built over the driver's parquet tables; the table writer.
functions  column-expression helpers (hashing, vector arithmetic, scalar maps).
operators  splits, metrics, relational steps, factor models, library ALS,
           tuning, recommendation, feature table, metric learning, predictors.
plans      the registered queries (DataFrame plans) and their DuckDB oracles.
"""

__version__ = "0.1.0"
