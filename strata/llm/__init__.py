"""Training-data operators: quality, language models, deduplication, packing
and mixing over a ``documents`` table. Nothing outside this subpackage
imports it."""

import sys

from pyspark import cloudpickle

# tasks carry this subpackage's code with them: workers needn't have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
