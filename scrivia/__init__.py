"""PySpark-native engine for versioned document collections and training text."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry this package's code along, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
