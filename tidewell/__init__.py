"""Spark-native analytics for follow-up conversations and the documents that ground them."""

import sys

from pyspark import cloudpickle

# functions for executors travel with their code, so that no worker needs the package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
