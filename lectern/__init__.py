"""Speakable-text analytics on Spark: corpus preparation, synthesis planning and playback telemetry."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# The kernels travel to the Python workers with their code, so workers need not find this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
