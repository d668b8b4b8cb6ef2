"""Operators for large training corpora; nothing outside this subpackage imports it.

Functions handed to Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
