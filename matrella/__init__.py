"""matrella: an annotated-matrix analytics engine made of lazy Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the Python workers by value: a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
