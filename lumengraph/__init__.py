"""lumengraph: versioned property graphs, vectors and training-data preparation on Spark DataFrames."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Python functions of this package travel to the executors with the plan, so they need no copy of it on their path.
register_pickle_by_value(sys.modules[__name__])
