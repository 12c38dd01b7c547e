"""A PySpark-native engine for fleet inventories and training data."""

import sys

from pyspark import cloudpickle

# what runs in tasks travels with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
