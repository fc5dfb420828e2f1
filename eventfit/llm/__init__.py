"""Operators for preparing large text corpora (training data)."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors with the tasks, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
