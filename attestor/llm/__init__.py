"""Training-data operators. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
