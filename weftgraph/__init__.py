"""A Spark-native graph and corpus analytics engine.

Everything is a DataFrame: vertices, edges, fragments, sparse matrices and
document tables.  Python code that has to run inside executors is shipped by
value, so that a cluster needs nothing but this driver's copy of the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
