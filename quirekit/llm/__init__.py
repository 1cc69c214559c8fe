"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage. Its functions reach the Python workers by
value, so executors need no installed copy of the package.
"""

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

import quirekit

register_pickle_by_value(quirekit)
