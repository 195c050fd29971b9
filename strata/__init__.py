"""strata: data preparation, profiling, time-series and ML analytics as Spark jobs.

Every operator is a DataFrame -> DataFrame function. Fitted constants
(means, quantiles, category lists) come from one aggregate whose size is
bounded by the number of columns, never by the number of rows.
"""

__version__ = "0.1.0"
