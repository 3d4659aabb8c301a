"""Strandline: ensemble analytics on PySpark.

Python kernels are shipped to executors by value, so a job needs no copy of
this package on the worker hosts.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
