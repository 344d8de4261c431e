"""Operators for preparing training corpora; nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])
