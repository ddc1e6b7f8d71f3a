"""textbench: Spark-native text-reconstruction and agent-data analytics.

Every operator is a function ``f(df, ...) -> DataFrame`` (or a column
function ``f(col, ...) -> Column``) that builds a lazy Spark plan.  Nothing
collects to the driver; scalar totals enter plans through one-row joins.
"""

import sys

from pyspark import cloudpickle

from textbench.session import get_session, checkpoint_dir

# functions that run on the executors travel with their code, so the workers
# need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
