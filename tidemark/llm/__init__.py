"""Operators for preparing language-model training data, and their queries."""

import sys

from pyspark import cloudpickle

# Functions run on executors travel with the task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
