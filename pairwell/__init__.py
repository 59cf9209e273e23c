"""Match a table of profiles against a table or stream of postings, on Spark."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
