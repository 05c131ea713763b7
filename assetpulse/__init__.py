"""Sensor analytics on Spark: readings on a time grid, robust baselines, anomaly events, proximity, risk and health."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
