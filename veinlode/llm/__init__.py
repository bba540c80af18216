"""Training-data operators: filtering, deduplication, mixing and sharding of text tables.

Nothing outside this package imports it. Worker functions are pickled by value, so executors
need neither this package on their path nor a shared folder that holds it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
