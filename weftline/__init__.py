"""Long-read overlap, layout and consensus as Spark jobs."""

import sys

from pyspark import cloudpickle

from weftline.config import AssemblyConfig, ScaleBounds

# Functions that run inside tasks travel with the plan, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AssemblyConfig", "ScaleBounds"]
