"""Operators for large-scale training-data pipelines (self-contained: nothing else in the library imports this)."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
