"""Retrieval data work over document corpora, expressed as Spark jobs.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is executed until the caller runs an action, except where a
docstring says that the size of a query side is checked first.
"""

import sys

from pyspark import cloudpickle

# Code that runs inside tasks travels with them, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
