"""Data-retention analytics on Spark: classify rows against policy, holds and tenants, measure, apply and audit."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so the executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
