"""Analytics for feature-by-sample measurement matrices on Spark.

Matrices are *long* tables of cells (``probe_id, sample_id, value``) or *packed* ones
(``probe_id, values``, in a given order of samples).  Operators take and return lazy
DataFrames; a missing value is null, never NaN.
"""
