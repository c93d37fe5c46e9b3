"""Curation and evaluation of text corpora on Spark."""

import sys

from pyspark import cloudpickle

#: Functions travel to the executors with their code: those need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
