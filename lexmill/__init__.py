"""Corpus vocabulary analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
