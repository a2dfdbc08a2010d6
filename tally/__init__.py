"""Spark jobs that turn dirty tabular feeds into trusted tables and defensible numbers."""

import sys

from pyspark import cloudpickle

# Ship the few pandas functions with their task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
