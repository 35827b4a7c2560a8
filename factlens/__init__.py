"""factlens: claim-verification analytics as Spark DataFrame jobs."""

import sys as _sys

try:  # ship UDF / pandas-function code with the task: workers need not import factlens
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):  # older cloudpickle: the package must be importable on workers
    pass
