"""A PySpark-native engine that learns names and terms from evidence and corrects text with them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
