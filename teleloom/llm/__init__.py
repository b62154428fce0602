"""Operators that prepare text corpora for model training."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, as they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
