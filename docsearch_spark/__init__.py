"""docsearch_spark: document search and retrieval evaluation as Spark DataFrame jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame. Nothing is collected to the driver except bounded broadcast material
(question blocks whose size is checked, see ``operators.search``).
"""

import sys as _sys

from docsearch_spark.session import get_spark, checkpoint_dir  # noqa: F401

# Ship this package's task functions (mapInArrow bodies and their helpers) to
# Python workers by value, so executors need no installed copy of it.
try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

__version__ = "0.1.0"
