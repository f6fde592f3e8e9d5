"""A spatio-temporal catalog engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in Python workers travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
