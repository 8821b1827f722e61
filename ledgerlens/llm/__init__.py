"""Operators for large-scale training-data pipelines (one module per operator).

The functions that run inside Python tasks are shipped by value, so executors need only the
third-party packages, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
