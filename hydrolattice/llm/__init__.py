"""Operators of a training-data pipeline over tables of texts, pages and labels.

Functions of this package travel by value with the tasks that call them, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
