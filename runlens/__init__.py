"""runlens: Spark-native analytics over benchmark runs and agent rollouts."""

import sys as _sys

__version__ = "0.1.0"

# Python workers (mapInPandas, applyInPandasWithState) receive runlens
# functions by value, so executors need no installed copy of the package.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
