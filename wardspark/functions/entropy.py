"""Shannon entropy in bits per character."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package installed


def _bits(text: str | None) -> float:
    if not text:
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(codes) if codes.max() < 0x3000 else np.unique(codes, return_counts=True)[1]
    shares = counts[counts > 0] / len(codes)
    return float(-(shares * np.log2(shares)).sum()) + 0.0


@pandas_udf(DoubleType())
def shannon_entropy(text: pd.Series) -> pd.Series:
    """Entropy of whole texts, counted over Arrow batches (about ten times faster here than array functions)."""
    return text.map(_bits)


def short_entropy(text: Column) -> Column:
    """The same for short strings and inside lambdas, as a plain expression."""
    size = F.length(text).cast("double")
    counts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))
