"""Relevia: tabular anomaly detection and explanation quality on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside each task, so it has to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
