"""Spark operators that turn feed items into ranked, checked question candidates."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
