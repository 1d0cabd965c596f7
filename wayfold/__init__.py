"""Network accessibility and data processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the executors with their code, so the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
