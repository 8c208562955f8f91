"""Many-to-many links resolved: which row belongs to which where a key is on both sides more than once.

Rows are compared field by field, strictest level first. At a level, a row of the registry and a row of the upload belong
together if they are the only ones left under their key with these values; both are then out of the later levels. The
last level compares nothing: it takes the one row and the one row that are left. What no level tells
apart is listed and not guessed.

Exact copies of a row are one row here, with their number. A missing value (null or blank) agrees with nothing. No
pairs are formed: a level is one partial aggregate by key and values, which a crowded key does not slow, and
an anti join with what the levels before took. Levels are stored, so a lost executor costs files to read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.functions.text import standardize_address
from rosterloom.operators.link import KEY, Linkage, many_to_many_keys, rows_under
from rosterloom.workspace import work_folder

_NAME = ("birth_date", "first_name", "last_name")
LEVELS: tuple[tuple[str, ...], ...] = (
    (*_NAME, "school_code", "case_number", "address"),
    (*_NAME, "case_number"),
    (*_NAME, "address"),
    _NAME,
    ("case_number",),
    (),
)
_SIDE, _CONTENT, _COPIES = "_side", "_content", "_copies"


@dataclass(frozen=True)
class Resolution:
    """`pairs`: key, level and the content of both rows. `rows`: per prefix the stored distinct rows under
    many-to-many keys, with content and copies."""

    cfg: MatchConfig
    pairs: DataFrame
    rows: dict[str, DataFrame]

    def left(self, side: Side) -> DataFrame:
        """The rows of one side without a partner."""
        taken = self.pairs.select(KEY, F.col(f"{_CONTENT}_{side.prefix}").alias(_CONTENT))
        return self.rows[side.prefix].join(taken, [KEY, _CONTENT], "left_anti")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distinct(link: Linkage, side: Side, keys: DataFrame) -> DataFrame:
    rows = rows_under(link, side, keys)
    names = sorted(c for c in rows.columns if c != KEY)
    # JSON names what is there, so a null is not taken for a blank or for its neighbour.
    content = F.md5(F.to_json(F.struct(*names)))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(_COPIES)).withColumn(_CONTENT, content)


def _compared(rows: DataFrame, side: Side, cfg: MatchConfig, fields: list[str]) -> DataFrame:
    values = {}
    for name in fields:
        value = F.col(side.col(getattr(cfg, name)))
        value = standardize_address(value) if name == "address" else F.trim(value)
        values[name] = F.when(value != "", value)
    return rows.select(KEY, F.lit(side.prefix).alias(_SIDE), _CONTENT, *[v.alias(f"_{n}") for n, v in values.items()])


def resolve(link: Linkage, levels: tuple[tuple[str, ...], ...] = LEVELS) -> Resolution:
    """Stores the many-to-many keys and their rows, and runs one job per level over them."""
    cfg, folder = link.cfg, work_folder(link.registry.sparkSession, "resolved")
    # Either side looks them up twice, and to count them takes the keys of all rows.
    keys = _stored(many_to_many_keys(link).select(KEY), f"{folder}/keys")
    rows = {side.prefix: _stored(_distinct(link, side, keys), f"{folder}/{side.prefix}") for side in cfg.sides}
    fields = list(dict.fromkeys(name for level in levels for name in level))
    contents = [f"{_CONTENT}_{side.prefix}" for side in cfg.sides]
    p, s = (F.when(F.col(_SIDE) == side.prefix, F.col(_CONTENT)) for side in cfg.sides)
    found = None
    for i, level in enumerate(levels, 1):
        so_far = Resolution(cfg, found, rows)
        left = reduce(DataFrame.unionAll, (
            _compared(so_far.left(side) if found is not None else rows[side.prefix], side, cfg, fields) for side in cfg.sides))
        values = [f"_{name}" for name in level]
        pairs = _stored(
            left.dropna(subset=values).groupBy(KEY, *values).agg(
                F.count(p).alias("n_p"), F.count(s).alias("n_s"), F.min(p).alias(contents[0]), F.min(s).alias(contents[1]))
            .filter("n_p = 1 AND n_s = 1").select(KEY, F.lit(i).cast("bigint").alias("level"), *contents),
            f"{folder}/pairs-{i}")
        found = found.unionAll(pairs) if found is not None else pairs
    return Resolution(cfg, found, rows)


def resolved_pairs(found: Resolution) -> DataFrame:
    """The rows that belong together, with all columns of both, the copies of either (n_p, n_s) and the level that told."""
    out = found.pairs
    for side, suffix in zip(found.cfg.sides, "ps"):
        content = f"{_CONTENT}_{side.prefix}"
        rows = found.rows[side.prefix].withColumnsRenamed({
            _CONTENT: content, _COPIES: f"n_{suffix}", **{f"join_key{i}": f"join_key{i}_{suffix}" for i in (1, 2)}})
        out = out.join(rows, [KEY, content]).drop(content)
    return out


def unresolved_rows(found: Resolution, side: Side) -> DataFrame:
    """The rows of one side that got no partner, with copies and why: `ambiguous` if the other side, too, has
    rows left under the key, else `surplus`."""
    other = next(s for s in found.cfg.sides if s != side)
    still = found.left(other).select(KEY).distinct().withColumn("_open", F.lit(True))
    why = F.when(F.col("_open"), "ambiguous").otherwise("surplus")
    return (found.left(side).join(still, KEY, "left").withColumn("reason", why)
            .withColumnRenamed(_COPIES, "copies").drop("_open", _CONTENT))
