"""Operators of a training-data pipeline: packing, deduplication, filters, mixing, token files.

Nothing else in the library imports this package. Functions that run on executors are
pickled by value, so workers need no copy of the package on their path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
