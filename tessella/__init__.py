"""tessella: spatial co-occurrence analytics on PySpark.

The functions that executors run are sent by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
