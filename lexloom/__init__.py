"""lexloom: document and retrieval analytics expressed as lazy Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run inside Arrow UDFs travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
