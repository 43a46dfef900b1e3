"""loadstone: hourly time-series and forecast-grading operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
