"""Spark-native analytics for conversations, event logs, text corpora and captured pages."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: the few Python functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
