"""termloom: keyword and short-text clustering analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to pandas operators travel with the task, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
