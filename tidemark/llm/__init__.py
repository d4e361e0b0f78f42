"""Operators that prepare training text: filters, near-duplicates, mixing and sharding."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
