"""Operators of a training-data pipeline.  Nothing else in the library imports
this package; it may import the library's general helpers.

Functions of this package that run inside tasks are shipped by value, so the
executors need numpy, pandas and pyarrow, but not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
