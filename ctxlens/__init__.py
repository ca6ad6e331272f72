"""ctxlens: Spark analytics for logs of LLM API requests and for code context."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python stages send this package's functions along, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
