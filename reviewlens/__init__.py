"""Review and sales analytics as plain DataFrame-to-DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors with their helpers, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
