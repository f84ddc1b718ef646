"""tessera: Spark-native analytics for collections of short texts and the typed graph between them."""

from pyspark import cloudpickle

import tessera as _self

# Functions of this package travel to the Python workers by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(_self)
