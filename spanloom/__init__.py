"""Spark-native analytics for measurement, survey and sensor data.

Every public function takes DataFrames and column names and returns a
DataFrame (or, in ``functions``, a Column), so Catalyst plans the whole job.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
