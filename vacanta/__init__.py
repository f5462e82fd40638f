"""Job-posting analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
