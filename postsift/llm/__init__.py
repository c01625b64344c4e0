"""Operations of a training-data pipeline.  Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Python tasks get the package's functions by value: the workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["postsift"])
