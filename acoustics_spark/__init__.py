"""Bioacoustic event data work as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
