"""Verse and corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so that
# executors need neither a copy of the package nor a path to one.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
