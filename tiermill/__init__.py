"""tiermill: candidate scoring, tiering and preference-pair mining as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
expression) keyed by explicit ids; no operator collects data to the driver.
"""

import sys as _sys

from tiermill.session import get_spark, shared_dir

# Functions that run in Python workers (mapInPandas bodies, reward
# functions) are pickled by value, so executors need not have this package
# installed or on their path.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
    pass

__all__ = ["get_spark", "shared_dir"]
