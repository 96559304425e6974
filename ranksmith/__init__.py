"""ranksmith: dense-retrieval data work (corpora, exact top-k, ranking
metrics, training-set preparation, loss audits) as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (mapInPandas,
# applyInPandas) are shipped by value, so executors need no copy of the
# package on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
