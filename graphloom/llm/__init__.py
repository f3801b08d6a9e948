"""Operators for preparing training text, one module each, and their registered queries.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
