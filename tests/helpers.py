"""Small rosters for tests: only the columns a test cares about need a value."""

from pyspark.sql.types import StringType, StructField, StructType

from rosterloom.config import ROSTER_COLUMNS, MatchConfig, ScaleLimits
from rosterloom.operators.clean import clean_roster, prefix_columns

SCHEMA = StructType([StructField(c, StringType()) for c in ROSTER_COLUMNS])
DEFAULTS = {"aun9_3": "1", "student_first_name": "ann", "student_last_name": "ash",
            "student_dob": "2015-01-02", "eligibility": "Free", "student_address1": "1 Oak St",
            "case_number": "c1", "school_code4": "0001", "parent_first_name": "pat",
            "parent_last_name": "ash"}

# Low limits: small rosters then take the plans for hot and crowded keys.
TIGHT = ScaleLimits(listed_districts=1, broadcast_bytes=1, slice_rows=8,
                    slice_pairs=20, pair_limit=4)


def roster(spark, rows):
    return spark.createDataFrame([tuple((DEFAULTS | r).get(c) for c in ROSTER_COLUMNS) for r in rows], SCHEMA)


def rosters(spark, registry, upload, cfg=MatchConfig()):
    """Both sides, prefixed and clean."""
    return tuple(clean_roster(prefix_columns(roster(spark, rows), side.prefix), side, cfg)
                 for side, rows in zip(cfg.sides, (registry, upload)))


def scalar_jaro(a, b):
    """Jaro, one pair, written plainly."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0
