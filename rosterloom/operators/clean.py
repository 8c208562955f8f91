"""From raw rosters to clean ones: prefixes, tidy keys, usable rows, rows of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.functions.text import is_filled, tidy_key
from rosterloom.operators.skew import broadcast_if_small
from rosterloom.workspace import work_folder


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Put `prefix_` before every column name but those in `keep`."""
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keep})


def clean_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tidy the named columns: cast to text, repair bytes, trim, lower-case."""
    return df.withColumns({c: tidy_key(F.col(c)) for c in columns})


def keep_identified(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows in which any of the named columns is null or blank."""
    for c in columns:
        df = df.filter(is_filled(F.col(c)))
    return df


def clean_roster(df: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Clean one prefixed roster and keep the rows that have a district and an ID."""
    present = [side.col(c) for c in cfg.key_columns if side.col(c) in df.columns]
    cleaned = clean_keys(df, present)
    return keep_identified(cleaned, [side.col(cfg.district), side.col(cfg.student_id)])


def restrict_to_batch(registry: DataFrame, upload: DataFrame,
                      cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Registry rows whose district occurs among the uploads.

    A short list of districts becomes a plain filter, which a Parquet scan can use to skip
    row groups. A longer one is stored and broadcast after measuring it. Should it be too long even
    for that, Spark chooses the join by the size of the stored table: only a list that is too long for it, too, makes
    it shuffle the rows of the registry, and adaptive execution splits crowded districts.
    """
    mine, theirs = cfg.registry.col(cfg.district), cfg.upload.col(cfg.district)
    found = upload.select(F.col(theirs).alias(mine)).distinct()
    listed = found.limit(cfg.limits.listed_districts + 1).collect()
    if len(listed) <= cfg.limits.listed_districts:
        return registry.filter(F.col(mine).isin([row[0] for row in listed]))
    spark = registry.sparkSession
    folder = work_folder(spark, "batch-districts")
    found.write.parquet(folder)
    batch = spark.read.schema(found.schema).parquet(folder)
    return registry.join(broadcast_if_small(batch, cfg.limits), mine, "left_semi")
