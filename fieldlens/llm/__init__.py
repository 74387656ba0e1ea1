"""Operators for training-data pipelines. Nothing outside this folder and ``corpus_pipeline.py`` imports it."""

import sys

from pyspark import cloudpickle

# Python tasks get the helpers of this folder by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
