"""tracewell: provenance-graph analytics and training-data operators, written for Spark.

Every operator is a function from DataFrames and parameters to a DataFrame. Nothing is executed
until the caller acts on the result, except where an iterative operator has to look at its own
progress; those write their rounds to the shared checkpoint folder (``plans.scratch``).
"""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
