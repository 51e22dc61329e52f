"""bytewright: finite-state text processing for PySpark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# functions that run in executors travel with their code, so executors need not have the package installed
register_pickle_by_value(sys.modules[__name__])
