"""factgraph: structural facts about source code as Spark DataFrames.

Two tables carry everything: ``nodes`` (entities) and ``edges`` (relations).
Every operator takes and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
