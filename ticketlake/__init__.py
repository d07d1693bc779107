"""Support-ticket analytics as Spark jobs over whole tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers whole, so the workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
