"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Functions that run on executors are sent by value, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
