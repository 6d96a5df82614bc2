"""Quality measurement of conversational systems on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
