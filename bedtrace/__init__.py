"""Alignment, interpolation and ensemble analytics for grouped, ordered measurement logs on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
