"""Checking the uploads against an official enrolment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def district_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values of a column; a missing value counts as one of them."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias("n_districts"))


def enrollment_lookup(df: DataFrame) -> DataFrame:
    """The columns the check reads from the official table."""
    return df.select("AUN", "County", "Total")


def enrollment_check(upload: DataFrame, official: DataFrame, district: str = "aun9_3",
                     name: str = "sfa_name") -> DataFrame:
    """Per school food authority: uploaded rows beside the official total.

    Reads the raw, unprefixed upload roster. District numbers are compared without
    dashes; a missing number equals a missing number. The uploads are counted before the
    join, so a large district is one row by then and neither side needs to be small. Of
    several totals within an authority the greatest is taken: 'the first' would depend on
    the order of the rows.
    """
    uploads = (upload.select(F.replace(district, F.lit("-"), F.lit("")).alias("AUN"), name)
               .groupBy("AUN", name).agg(F.count(F.lit(1)).alias("n")))
    lookup = enrollment_lookup(official).withColumnRenamed("AUN", "official_AUN")
    joined = uploads.join(lookup, F.col("AUN").eqNullSafe(F.col("official_AUN")), "left")
    return joined.groupBy(name).agg(
        F.sum("n").alias("SEBT_Count"), F.max("Total").alias("Official_Enrollment"))
