"""IDs that only one of the two rosters has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.operators.clean import keep_identified
from rosterloom.operators.link import Linkage
from rosterloom.workspace import work_folder

ID = ["AUN", "PAsecureID"]


def _listed(cfg: MatchConfig) -> dict[str, str]:
    return {cfg.district: "AUN", cfg.student_id: "PAsecureID", cfg.first_name: "FirstName", cfg.last_name: "LastName"}


def id_list(df: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Distinct district, ID and name of one roster."""
    usable = keep_identified(df, [side.col(cfg.student_id), side.col(cfg.district)])
    return usable.select(*[F.col(side.col(c)).alias(n) for c, n in _listed(cfg).items()]).distinct()


def one_sided_ids(link: Linkage) -> DataFrame:
    """IDs known to one roster only, compared within the district, labelled by side.

    Names play no part in the comparison: a student linked by name is listed as well.

    The rows of both sides are counted once, per district and ID: a bit for each side, and the first and the
    last name. That is all for IDs with up to two names. It is stored, and only if there are one-sided
    IDs with more names are rows read again, just for these.
    """
    cfg, spark = link.cfg, link.registry.sparkSession
    usable = []
    for bit, side in enumerate(cfg.sides):
        rows = keep_identified(link.plain_rows(side), [side.col(cfg.student_id), side.col(cfg.district)])
        usable.append(rows.select(*[F.col(side.col(c)).alias(n) for c, n in _listed(cfg).items()],
                                  F.lit(1 << bit).alias("sides")))
    rows = usable[0].unionByName(usable[1])
    name = F.struct("FirstName", "LastName")
    per_id = rows.groupBy(*ID).agg(F.bit_or("sides").alias("sides"), F.min(name).alias("least"), F.max(name).alias("most"))
    alone = per_id.filter(F.col("sides") != 3)
    folder = work_folder(spark, "one-sided")
    alone.write.parquet(folder)
    alone = spark.read.schema(alone.schema).parquet(folder)
    several = ~F.col("least").eqNullSafe(F.col("most"))
    label = F.when(F.col("sides") == 1, cfg.registry.label).otherwise(cfg.upload.label).alias("Source")
    found = alone.filter(~several).select(*ID, "least.*", label)
    if alone.filter(several).isEmpty():
        return found
    more = rows.join(alone.filter(several).select(*ID), ID, "left_semi").select(*ID, "FirstName", "LastName", label)
    return found.unionByName(more.distinct())
