"""Spark-native data processing for crawled-document audits."""

import sys

from pyspark import cloudpickle

# Functions sent to the Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
