"""Document question answering and retrieval analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions run on executors travel with the plan, so the package does not
# have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
