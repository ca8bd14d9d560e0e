"""Spark-first analytics over technology records, with a training-data toolkit in ``corvane.llm``.

Functions of this package that run on executors travel by value, so a cluster
needs the package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
