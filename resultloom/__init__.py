"""Search-result intelligence on Spark: normalise, link, score, rank, evaluate."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with their task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
