"""orchard: pool-based active learning as Spark DataFrame operators.

Sub-packages
------------
sources    loaders and sinks (delimited text, CSV, the driver's Parquet tables, models)
functions  column expressions (recodes, unit vectors, committee scores, random keys)
operators  table operators (prep, pool state, committee votes, similarity, selection, evaluation)
plans      composed jobs (active-learning round loop, supervised fit/evaluate jobs, registered queries)
"""

__version__ = "0.1.0"

# Functions handed to Spark (pandas UDFs, applyInPandas, mapInPandas) are
# pickled by value, so Python workers need no installed copy of the package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files
    pass
