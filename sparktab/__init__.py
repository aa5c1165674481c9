"""sparktab: tabular preparation, modelling and audit jobs written for PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
