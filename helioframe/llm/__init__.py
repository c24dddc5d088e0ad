"""Operators for preparing training text. Nothing outside this folder and ``corpus_pipeline.py`` imports them."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
