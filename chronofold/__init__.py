"""Point-in-time evidence and forecasting analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
