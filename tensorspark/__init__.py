"""Sparse-tensor CP analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tensorspark.operators.cpals import CpOptions, CpResult, cpals
from tensorspark.operators.mttkrp import mttkrp, mttkrp_all
from tensorspark.sources.reader import read_tensor
from tensorspark.tensor import SparseTensor

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "CpOptions",
    "CpResult",
    "SparseTensor",
    "cpals",
    "mttkrp",
    "mttkrp_all",
    "read_tensor",
]
