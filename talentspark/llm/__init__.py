"""Operators of the training-data pipeline; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so no copy of the package is needed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
