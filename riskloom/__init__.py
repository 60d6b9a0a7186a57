"""riskloom: the data side of risk-model operations as Spark jobs."""

import sys

from pyspark import cloudpickle

# column functions travel to the executors whole, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
