"""Spark-native analytics over repeated-trial evaluation records."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
