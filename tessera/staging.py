"""Tables that outlive a job: Parquet in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder; a cluster has none that all its machines
    see, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def reach(spark: SparkSession, path: str | None = None) -> str | None:
    """The shared folder, or a path in it, as pyarrow names it; None where only Spark reads it."""
    place = re.sub(r"^file:/+", "file:///", path or shared_dir(spark))
    try:
        system, at = fs.FileSystem.from_uri(place)
        return place if system.get_file_info(at).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def stage(df: DataFrame, folders: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; `folders`: a column, a folder for each of its values.

    This cuts the lineage, survives the loss of executors, and gives the planner the exact size, so that a join
    with the result is broadcast only below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.partitionBy(*[folders] if folders else []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete tables that stage() wrote and that nothing reads any more; other tables are left alone."""
    for df in staged:
        if path := getattr(df, "staged_at", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def gapless(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, staged, with `name`: the place of each row in `order`, from 0 without gaps; ties in any order.

    Rows are dealt by ranges and numbered within each; a range starts where those before it end. So no task sees more
    than a range, where a window over all rows would be one task.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), inside.alias("_inside"))
    rows = stage(ranged)
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # a row for each range
    starts, at = [], 0
    for number in sorted(sizes):
        starts.append((number, at))
        at += sizes[number]
    ranges = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return rows.join(F.broadcast(ranges), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")
