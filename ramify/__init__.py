"""Analytics over named sets, hierarchies, ranked entities and records, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
