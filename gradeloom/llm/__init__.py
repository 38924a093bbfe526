"""Operators for preparing training corpora."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel whole: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
