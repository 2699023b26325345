"""Spark-native text analytics: scoring, style profiles, corpus management."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
