"""Operators for preparing training corpora: extraction, quality, near
duplicates, decontamination, mixing, scoring and token output.

Nothing outside this folder imports it except the guarded registration in
``__spark_entry__`` and ``corpus_pipeline``.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with the job, so executors need no copy of this
# package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
