"""framewright: ordered-trace analytics and corpus operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value: they need no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
