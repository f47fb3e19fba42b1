"""Operations analytics and sensitive-data scanning as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the small Python helpers used inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
