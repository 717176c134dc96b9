"""Spark DataFrame operators for spatial tissue-feature analytics."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the task, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
