"""datamill: build, label, score and judge training data for small text models on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task-side helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
