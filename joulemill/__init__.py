"""Spark jobs that account the carbon cost of batch work, with the relational toolbox around them."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
