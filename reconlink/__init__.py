"""Document-to-registry reconciliation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from reconlink.config import Thresholds

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Thresholds"]
