"""tamarack: an Access-SQL engine and data-processing operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are sent by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
