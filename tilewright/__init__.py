"""Raster and terrain tile analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# batch functions travel with the query, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
