"""Trade-ledger analytics on Spark DataFrames.

``sources`` reads, ``functions`` holds column expressions, ``operators`` the relational building
blocks, ``plans`` the report queries and their SQL, ``streaming`` the incremental forms. The
subpackage ``llm`` is optional: nothing else imports it.
"""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
