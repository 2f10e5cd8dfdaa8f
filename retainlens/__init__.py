"""retainlens — customer-attrition analytics as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a small
driver-side value when the result is a k×k matrix or a handful of scalars).
Subpackages:

* ``sources``   — readers / writers (CSV, Parquet, JSON prediction log, reports, models)
* ``functions`` — Column-expression builders (yes/no flags, buckets, entropy, p-values)
* ``operators`` — table operators: cleaning, features, profiling, statistics,
                  drift, preprocessing, training, scoring, evaluation, monitoring
* ``plans``     — end-to-end jobs (views over the driver tables, train / evaluate /
                  monitor / retrain) and the query catalogue
* ``streaming`` — Structured Streaming scoring, windowed stats, drift per batch
"""

__version__ = "0.1.0"

import sys as _sys

try:  # Ship our UDF / applyInPandas helpers to executors by value: no --py-files needed.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 — older cloudpickle: fall back to shipping the package
    pass
