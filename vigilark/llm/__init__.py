"""Training-data operators at corpus scale, one module each, and their registered queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their tasks; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
