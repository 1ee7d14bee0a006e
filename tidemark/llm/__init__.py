"""Operators for preparing training text at scale.  Nothing else in the library imports this subpackage.

Functions that run on executors travel by value, so the executors need no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
