"""Training-data operators: ten corpus jobs expressed on DataFrames.

Nothing outside this folder imports it.  Functions that run in Python workers are
pickled by value, so the executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
