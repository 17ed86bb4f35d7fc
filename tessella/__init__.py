"""tessella: a Spark-native engine for collections of short knowledge texts."""

import sys

from pyspark import cloudpickle

__version__ = "0.4.0"

# Functions that run in tasks travel with the job, so workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
