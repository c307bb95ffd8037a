"""Code-corpus retrieval as Spark jobs: inventory, selection, chunking, embedding,
vector tables, top-k search, context packing and interaction logs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run inside Python workers travel with the job, so executors need
# no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
