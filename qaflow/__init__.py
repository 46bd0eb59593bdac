"""qaflow: retrieval-augmented question answering over tables, on Spark."""

import sys as _sys

try:  # ship this package's Python code to workers inside the task closures
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: workers need the package installed
    pass

__all__ = []
