"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so that a cluster needs only the driver's copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
