"""Retrieval evaluation at corpus scale, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from chunkrank.plans.evaluate import evaluate  # noqa: E402
from chunkrank.schema import RetrievalSet  # noqa: E402
from chunkrank.sources.readers import read_chunked, read_length_tasks, read_triples  # noqa: E402

__all__ = ["RetrievalSet", "evaluate", "read_chunked", "read_length_tasks", "read_triples"]
