"""Artifacts from a directory tree or from a table."""

import os
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardspark.catalog import patterns as cat
from wardspark.functions.text import basename, decode_text, suffix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH_BYTES = 32 << 20
_ONE_SPLIT = 32 << 20


def artifacts_from_table(df: DataFrame, path: Column, text: Column, target: Column) -> DataFrame:
    """Artifacts from any table: say which expressions give path, text and target."""
    return df.select(path.cast("string").alias("path"), target.cast("string").alias("target"), text.cast("string").alias("content"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shares an input of at most 32 MB on disk out over all cores by ``key``; any other is left as it is.

    A file with a single row group is read by one task, however many cores there are. The bound is fixed and checked, so what is
    shuffled for this grows neither with the cluster nor with the data.
    """
    spark = df.sparkSession
    if df.isStreaming or _bytes_on_disk(spark, df.inputFiles()) > _ONE_SPLIT:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def _bytes_on_disk(spark: SparkSession, files: list[str]) -> int:
    """The size of a few files; more than a handful are not one split's worth of small input."""
    if len(files) > 8:
        return _ONE_SPLIT + 1
    sizes = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first() if files else None
    return (sizes[0] or 0) if sizes else 0


def scannable(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether a file is looked at: by its extension, or a name that starts with ``.env``."""
    name = basename(path)
    return F.lower(suffix(path)).isin(list(extensions or cat.SCAN_EXTENSIONS)) | F.startswith(name, F.lit(".env"))


def in_ignored_directory(path: Column) -> Column:
    """Whether any directory of the path is on the ignore list or hidden."""
    directories = F.filter(F.split(path, "/"), lambda part, i: (part != "") & (i < F.size(F.split(path, "/")) - 1))
    return F.exists(directories, lambda d: d.isin(cat.IGNORED_DIRECTORIES) | F.startswith(d, F.lit(".")))


def _subdirectories(directory: str) -> list[str]:
    with os.scandir(directory) as entries:
        return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and _entered(e.name))


def _entered(name: str) -> bool:
    return name not in cat.IGNORED_DIRECTORIES and not name.startswith(".")


def read_artifacts(spark: SparkSession, root: str, extensions: list[str] | None = None, min_tasks: int | None = None) -> DataFrame:
    """Files below ``root`` as ``path, target, content``; a single file is read whatever its name.

    The folder must be mounted on every executor. The driver opens directories only until there are enough of them
    to share out; tasks walk the rest. The listed paths are then spread evenly before any file is read, so that one
    large directory does not read on one task. Weight files are listed without content.
    """
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    wanted_tasks = min_tasks or spark.sparkContext.defaultParallelism * 4
    if os.path.isfile(root):
        listed = spark.createDataFrame([(root,)], "path string")
    else:
        opened, waiting = [], [root]
        while waiting and len(opened) + len(waiting) < wanted_tasks:
            directory = waiting.pop(0)
            opened.append(directory)
            waiting.extend(_subdirectories(directory))
        shares = [(d, False) for d in opened] + [(d, True) for d in waiting]
        listed = spark.createDataFrame(shares, "directory string, deep boolean").repartition(max(1, len(shares))).mapInArrow(_list_files, "path string")
        listed = listed.where(scannable(F.col("path"), extensions)).repartition(wanted_tasks, "path")
    content = F.when(~F.lower(suffix(F.col("path"))).isin(cat.BINARY_EXTENSIONS), decode_text(F.col("bytes")))
    return listed.mapInArrow(_read_files, "path string, bytes binary").select("path", F.lit(root).alias("target"), content.alias("content"))


def _list_files(batches):
    for batch in batches:
        for directory, deep in zip(batch.column("directory").to_pylist(), batch.column("deep").to_pylist()):
            for folder, subfolders, files in os.walk(directory):
                subfolders[:] = [d for d in subfolders if _entered(d)] if deep else []
                yield pa.RecordBatch.from_arrays([pa.array([os.path.join(folder, f) for f in files], pa.string())], ["path"])


def _read_files(batches):
    rows = lambda paths, data: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], ["path", "bytes"])
    paths, contents, held = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            paths.append(path)
            contents.append(_bytes_of(path))
            held += len(contents[-1] or b"")
            if held > _BATCH_BYTES:
                yield rows(paths, contents)
                paths, contents, held = [], [], 0
    yield rows(paths, contents)


def _bytes_of(path: str) -> bytes | None:
    """None for weight files, and for files that cannot be read: both are scanned by name only."""
    if os.path.splitext(path)[1].lower() in cat.BINARY_EXTENSIONS:
        return None
    try:
        with open(path, "rb") as handle:
            return handle.read()
    except OSError:
        return None
