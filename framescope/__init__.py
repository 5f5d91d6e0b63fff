"""Analytics over frame-profile recordings, expressed as Spark DataFrames.

Every function takes and returns DataFrames.  A missing measurement is SQL
NULL, never zero.  ``capture_id`` is an ordinary column, so every operator
works on many recordings at once.
"""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so a cluster needs no
# separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
