"""Gridded-observation analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from swathgrid.grid import Grid

# Functions that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid"]
