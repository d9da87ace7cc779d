"""Contact-data integration as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

from contactloom.config import Config

# Functions that run in Python workers travel with the query, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Config"]
