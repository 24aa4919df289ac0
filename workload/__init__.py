"""Test inputs derived from the given tables, the named queries over them and their SQL."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that make rows inside tasks travel with the plan
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
