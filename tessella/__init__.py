"""A document retrieval and retrieval evaluation engine in PySpark."""

import sys

from pyspark import cloudpickle

# Executors get the code of functions with them and need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
