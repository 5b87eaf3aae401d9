"""Operators for preparing text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
