"""answerbank: Spark-native question/answer retrieval and evaluation operators."""

import sys as _sys

try:  # ship this package's functions to Python workers by value (no install needed on executors)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except ImportError:  # pragma: no cover - no bundled cloudpickle
    pass
