"""Corpus operators for training-data pipelines.

Nothing else in the library imports this package. Worker-side functions are shipped by
value, so executors need no copy of the package on their path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
