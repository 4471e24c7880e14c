"""weftline: a Spark-first engine for versioned records, text, vectors and graphs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
