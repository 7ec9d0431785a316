"""Data jobs for identity verification on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
