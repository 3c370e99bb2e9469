"""plotfield: designed-experiment and panel analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks are shipped by value, so executors
# do not need this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
