"""Documents and logs as JSON files: read with a schema, written line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document, or a folder of them, one row each; None where there is nothing at `path`."""
    return spark.read.schema(schema).option("multiLine", "true").json(path) if _there(spark, path) else None


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a JSON lines file or folder; blank lines are passed over, and no file is no record.

    A line that is no object of this schema is an error, as a ledger has none to lose.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_ledger(records: DataFrame, path: str) -> None:
    """Add records to a folder of JSON lines; nulls are kept."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def vectors(rows: DataFrame, column: str = "vector_json") -> DataFrame:
    """rows with `vector` from a JSON text; rows whose text is no list of numbers are dropped."""
    read = rows.withColumn("vector", F.from_json(column, "array<double>"))
    numbers = F.forall("vector", lambda x: x.isNotNull())
    # Quoted numbers would be read as numbers.
    return read.where(F.col("vector").isNotNull() & numbers & ~F.contains(F.col(column), F.lit('"')))
