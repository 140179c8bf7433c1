"""Small tables out of rows held by the program, with sizes the optimizer knows."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of configuration rows. Made from Arrow, so it is a local relation: a join with it is a broadcast
    because of its known size, without a hint."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return spark.createDataFrame(pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema))
