"""Spark-native analytics for hydrophone recordings and vessel tracks.

Every operator is a function from DataFrame to DataFrame (or Column to Column);
Spark plans, shuffles and runs the work.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the executors inside the task, so the package does not have
# to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
