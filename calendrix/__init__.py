"""Event-calendar curation and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
