"""Transcript evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship our Python functions inside the tasks, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
