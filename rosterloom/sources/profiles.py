"""Whether the columns of each file are where they should be, by the look of their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.text import WHITESPACE

# What a filled cell of a column looks like, as a pattern on the trimmed cell. Only for columns with a look of their own.
SHAPES = {
    "aun9_3": r"[0-9]{3}-?[0-9]{6}|[0-9]{3}-?[0-9]{3}-?[0-9]{3}",
    "pasecureid": r"[0-9]{10}",
    "student_dob": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
    "student_state": r"[A-Za-z]{2}",
    "student_zip": r"[0-9]{5}(-?[0-9]{4})?",
    "eligibility": r"(?i)free|reduced|paid|denied|other",
    "parent_email": r"[^@ ]+@[^@ ]+",
}


def column_profiles(parsed: DataFrame, shapes: dict[str, str] = SHAPES) -> DataFrame:
    """Per file (`_file`) and column with a shape: filled cells, how many have the shape, and the column of the file most of
    whose cells have it (`best`, its share `best_share`; the first such column).

    Reads what `parsed_folder` stored once. Cells become rows of their own, which are counted before any shuffle.
    """
    columns = [c for c in parsed.columns if not c.startswith("_")]
    wanted = [c for c in shapes if c in columns]
    cells = parsed.filter(~F.col("_header")).select("_file", F.posexplode(F.array(*columns)).alias("place", "cell"))
    trimmed = cells.select("_file", "place", F.btrim("cell", F.lit(WHITESPACE)).alias("cell"))
    filled = trimmed.filter((F.col("cell") != "") & (F.col("cell") != "NA"))
    counts = filled.groupBy("_file", "place").agg(F.count(F.lit(1)).alias("filled"), *[
        F.count_if(F.col("cell").rlike(f"^(?:{shapes[c]})$")).alias(c) for c in wanted])
    # From here on there is a row per file and column.
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(columns.index(c)).alias("own"), F.col(c).alias("fits"))
                              for c in wanted]))
    long = counts.select("_file", "place", "filled", each)
    share = (F.col("fits") / F.col("filled")).alias("share")
    best = F.max(F.struct(share, (-F.col("place")).alias("place"))).alias("best")
    mine = F.col("place") == F.col("own")
    return long.groupBy("_file", "column").agg(
        F.sum(F.when(mine, F.col("filled")).otherwise(0)).alias("filled"),
        F.sum(F.when(mine, F.col("fits")).otherwise(0)).alias("fitting"), best).select(
        "_file", "column", "filled", "fitting",
        F.element_at(F.array(*map(F.lit, columns)), 1 - F.col("best.place")).alias("best"), F.col("best.share").alias("best_share"))


def misplaced_columns(profiles: DataFrame, least: float = 0.5) -> DataFrame:
    """The columns of files less than `least` of whose filled cells have the column's shape: _file, column, filled, fitting and
    `likely`, the column that seems to hold its cells; null if none fits. A column without filled cells says
    nothing."""
    likely = F.when((F.col("best_share") >= least) & (F.col("best") != F.col("column")), F.col("best"))
    return profiles.filter(F.col("fitting") < least * F.col("filled")).select(
        "_file", "column", "filled", "fitting", likely.alias("likely"))
