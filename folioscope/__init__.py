"""Disclosure and discussion analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks are pickled by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
