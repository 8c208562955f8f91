"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word, where an operator counts words: everything between these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# A key with more than one of so many equal shares of the rows is dealt over several tasks.
SHARES = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept_as(df: DataFrame, path: str) -> DataFrame:
    """`df` written as Parquet and read back: later steps start from the files, which
    survive lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Python workers get texts a few MB at a time; long texts go one by one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores in front until no frame has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(a: Column, b: Column) -> Column:
    """Equality by which null equals null."""
    return a.eqNullSafe(b)


def looked_up(rows: DataFrame, known: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """`rows` joined to `known`, which has one row per key, such that no key's rows meet in one task.

    A key with more than one of SHARES equal shares of the rows is dealt over as many parts as it has
    shares, and its row of `known` is repeated for each. There are fewer such keys than shares, and at most 2 * SHARES
    rows more in `known`. `sizes` (key, n) says how many rows a key has, where that is cheaper to count
    elsewhere. Rows are dealt in the order of their partitions, so they should come from files.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts, part = unused("parts", rows, known), unused("part", rows, known)
    heavy = F.broadcast(sizes.filter(F.col("n") * SHARES > total).select(
        key, F.ceil(F.col("n") * SHARES / F.lit(max(total, 1))).cast("bigint").alias(parts)))
    one = F.lit(1).cast("bigint")
    dealt = rows.join(heavy, key, "left").withColumn(
        part, F.pmod(F.monotonically_increasing_id(), F.coalesce(parts, one))).drop(parts)
    copies = known.join(heavy, key, "left").withColumn(
        part, F.explode(F.sequence(one - 1, F.coalesce(parts, one) - 1))).drop(parts)
    return dealt.join(copies, [key, part]).drop(part)


def word_count(text: Column) -> Column:
    """Words of a text; none of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
