"""Operators for building training-data corpora, and their registered queries.

Functions that run in Spark's Python workers travel by value, so executors need
not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
