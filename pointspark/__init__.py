"""pointspark: point-cloud analytics as composable DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run on executors travel with the plan, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
