"""Operators for building training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: the cluster's Python needs the
# third-party libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
