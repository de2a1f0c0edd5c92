"""Helpers shared by the operators: staged tables, gapless ranks, Arrow batch size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, so that a batch of long texts fits a worker; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner the exact size, so that a join
    with the result is broadcast only below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
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


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by their bytes; always the same bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: The column that holds those that an operator does not read, so that their names can clash with none of its own.
OTHERS = "_other_columns"


def set_apart(df: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """The columns of `used` that df has, and a struct of all others."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    kept = [F.col(c) for c in used if c in df.columns]
    return df.select(*kept, F.struct(*others).alias(OTHERS)) if others else df.select(*kept)


def put_back(df: DataFrame, columns: list[str], used: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """The columns as they were before set_apart, but for those of `more`, which come last as they are now."""
    old = [F.col(c) if c in used else F.col(f"{OTHERS}.`{c}`").alias(c) for c in columns if c not in more]
    return df.select(*old, *[F.col(c) for c in more])


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Add `name`: the place of a row within its group, from 0 without gaps.

    A window over the group alone would bring a hot group into one task. Rows are instead dealt to `buckets` by a
    hash of `order`; each (group, bucket) is numbered by itself and starts where the buckets before it end. Ties in
    `order` get different places in any order.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_place", F.row_number().over(inner) - 1)
    return (
        numbered.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_bucket", "_start", "_place")
    )


def bucket_count(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    return max(least, -(-rows // per_bucket))


def salted_lookup(df: DataFrame, small: DataFrame, key: str | list[str], row: Column, salts: int = 16) -> DataFrame:
    """df with the columns of `small`, inner join on `key` (unique in `small`), where a key may hold a third of df.

    `small` is repeated `salts` times and df's rows are dealt over them by a hash of `row`, so that a hot key is met in
    so many tasks where the planner does not broadcast.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(row, F.lit(salts)), F.lit(salts)).cast("int"))
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


#: Bits for each key of the filter of possibly(), and the fewest and most bits it has; the most are 8 MB.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 26


def possibly(df: DataFrame, column: Column, keys: DataFrame, key: Column, name: str = "_maybe") -> DataFrame:
    """Add `name`: false where `column` surely is no `key` of `keys`, true where it may be one.

    A bit map of hashes, of a size that follows the number of keys up to MOST_BITS, is broadcast. It spares rows a
    shuffle before an exact join; with very many keys it only spares fewer. `keys` should be staged.
    """
    wanted = max(LEAST_BITS, min(MOST_BITS, FILTER_BITS * keys.count()))
    mask = F.lit((1 << (wanted - 1).bit_length()) - 1)
    place = F.xxhash64(key).bitwiseAND(mask)
    bits = keys.select(place.alias("_p")).select(F.shiftright("_p", 6).alias("_word"), F.expr("shiftleft(1L, cast(_p & 63 AS int))").alias("_bit"))
    words = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = df.withColumn("_p", F.xxhash64(column).bitwiseAND(mask)).withColumn("_word", F.shiftright("_p", 6))
    seen = own.join(F.broadcast(words), "_word", "left")
    return seen.withColumn(name, F.coalesce(F.expr("shiftright(_bits, cast(_p & 63 AS int)) & 1L = 1L"), F.lit(False))).drop("_word", "_bits", "_p")
