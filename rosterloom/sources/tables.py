"""Stored tables: the registry snapshot, the official enrolment, the results of a batch."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.plans.enrollment import enrollment_lookup


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The versions of a snapshot, as far as they are complete; None if there is none."""
    try:
        return spark.read.schema("number bigint, version string").parquet(f"{path}/current")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(versions: DataFrame):
    return versions.orderBy(F.desc("number"), F.desc("version")).first()


def save_snapshot(roster: DataFrame, path: str, side: Side, cfg: MatchConfig = MatchConfig(),
                  mode: str = "error") -> None:
    """Store a clean roster as Parquet, ranged and sorted by district and ID.

    A batch then reads only the row groups of its districts. Content and position are the
    last range keys, so that the rows of a crowded ID, copies included, make several files.

    Every build is a folder of its own, and the list of versions gets a row when it is complete. So a build
    that dies leaves the snapshot as it was, and batches that read an earlier version go on. With mode "error"
    there must be none; with "overwrite" the new one takes its place. Earlier versions stay until they are removed.
    """
    spark, versions = roster.sparkSession, _versions(roster.sparkSession, path)
    last = versions and _latest(versions)
    if last and mode != "overwrite":
        raise FileExistsError(f"there is a snapshot at {path}")
    order = [side.col(cfg.district), side.col(cfg.student_id)]
    placed = roster.withColumns({"_content": F.xxhash64(*roster.columns),
                                 "_place": F.monotonically_increasing_id()})
    ranged = placed.repartitionByRange(*order, "_content", "_place").sortWithinPartitions(*order)
    version = f"version-{uuid.uuid4().hex}"
    ranged.drop("_content", "_place").write.parquet(f"{path}/{version}")
    number = last.number + 1 if last else 1
    spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(version).alias("version")).write.mode(
        "append").parquet(f"{path}/current")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version of a snapshot."""
    versions = _versions(spark, path)
    last = versions and _latest(versions)
    if not last:
        raise FileNotFoundError(f"no complete snapshot at {path}")
    return spark.read.parquet(f"{path}/{last.version}")


def read_enrollment(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The official enrolment table, from Parquet or from CSV with a header."""
    if form == "csv":
        cells = spark.read.option("header", True).csv(path)
        return enrollment_lookup(cells).withColumn("Total", F.col("Total").cast("bigint"))
    return enrollment_lookup(spark.read.parquet(path))


def batch_path(folder: str, batch: str) -> str:
    """Folder of one batch; readers of `folder` see `batch` as a partition column."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError("a batch name has letters, digits, dots, dashes and underscores only")
    return f"{folder.rstrip('/')}/batch={batch}"


def write_batch(result: DataFrame, folder: str, batch: str, form: str = "parquet") -> str:
    """Write one result of a batch, replacing an earlier run of that batch only.

    Part files are numbered in the order of the rows, so a sorted summary stays sorted.
    """
    path = batch_path(folder, batch)
    writer = result.write.mode("overwrite")
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)
    return path


def write_named_file(result: DataFrame, folder: str, batch: str, name: str) -> str:
    """Write a small result, such as one row per district, as one CSV file `<batch>_<name>.csv`.

    The file is written beside and then renamed: readers see the old one or the new one. One task writes
    it, in the order of the rows.
    """
    path = f"{batch_path(folder, batch).rpartition('/')[0]}/{batch}_{name}.csv"
    beside = f"{path}.{uuid.uuid4().hex}"
    result.coalesce(1).write.option("header", True).csv(beside)
    context = result.sparkSession.sparkContext
    paths = context._jvm.org.apache.hadoop.fs.Path
    store = paths(beside).getFileSystem(context._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in store.listStatus(paths(beside)) if f.getPath().getName().startswith("part-")]
    store.delete(paths(path), False)
    if not store.rename(part, paths(path)):
        raise OSError(f"could not rename to {path}")
    store.delete(paths(beside), True)
    return path
