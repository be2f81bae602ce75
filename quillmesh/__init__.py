"""quillmesh: analytics over a personal knowledge base, written for PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers carry their own code; the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
