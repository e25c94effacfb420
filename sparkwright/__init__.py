"""sparkwright: feature encoding, vector, clustering, sequence and label work on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so the package needs no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
