"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_NORM = 1e-12


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalised(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    scale = F.greatest(norm(vector), F.lit(SMALLEST_NORM))
    return F.transform(vector, lambda x: x.cast("double") / scale)


def mean_vector(vector: Column) -> Column:
    """Aggregate: element-wise mean. Partial sums combine before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))
