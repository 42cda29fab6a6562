"""kinelake: robot-episode analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers as code, so that a job may start from any folder and workers need no copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
