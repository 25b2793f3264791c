"""Training-data operators: quality rules, joins on shingles, deduplication, masking, mixing, packing.

Nothing outside this subpackage imports it.  Functions of this subpackage that run in Python workers are
pickled by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
