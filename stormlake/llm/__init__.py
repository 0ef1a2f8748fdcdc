"""Operators for language-model training data; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Tasks receive the code of this subpackage with the job, so executors need not have it
# installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
