"""plumbline: profile, clean, compare, value and synthesise tables on Spark.

Every operator is a plain function over ``DataFrame``; see ``README.md`` for the map.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job, so workers need no copy of the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
