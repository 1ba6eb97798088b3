"""logweave: log analytics on Spark DataFrames and Structured Streaming.

Raw log lines become structured entries, near-identical messages are
grouped, pattern frequencies are tracked in event-time windows, and
incidents, alerts and summaries are derived from them.  Every operator is a
``DataFrame -> DataFrame`` function; thresholds and ``as_of`` are
parameters, never the wall clock.
"""

__version__ = "0.1.0"

import sys as _sys

try:  # ship UDF and mapInPandas code to Python workers by value: executors
    # need no installed copy of this package
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the API
    pass
