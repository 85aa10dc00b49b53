"""Market-surveillance analytics on Apache Spark.

Every operator is a function from DataFrames to a DataFrame; nothing is collected
to the driver.  See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

from pitwarden.config import BarConfig, DetectorConfig, FeatureConfig

# Functions sent to Python workers carry their own code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BarConfig", "DetectorConfig", "FeatureConfig"]
