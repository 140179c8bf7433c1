"""Arrow batches of texts, a few megabytes at a time."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of texts that are looked at together.
_LOOK_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at the size of one look, unless the caller has set a size.

    A Python process holds up to two batches; by Spark's default they grow with the partition up to 64 MB each.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, f"{_LOOK_BYTES}b")


def looks(texts: pa.Array, size: int = _LOOK_BYTES):
    """A batch in slices of about so many bytes, at least one text each: what is made of a text in Python is held for one slice, not for the batch."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
