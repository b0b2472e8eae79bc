"""Document-overlap engine on Spark: ingest, segment, match, rank, report, locate.

Functions go to executors by value, so the package need not be on their path."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
