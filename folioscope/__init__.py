"""Document retrieval and usage analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
