"""Evaluation of searches at a matched false-alarm rate, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
