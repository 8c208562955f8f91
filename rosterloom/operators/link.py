"""Linking two clean rosters: by district and ID, else by district, name and birth date."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.functions.text import text_key
from rosterloom.operators.clean import restrict_to_batch
from rosterloom.operators.skew import ROW, HotKeys, with_row_numbers

ID_KEY, NAME_KEY, KEY = "join_key1", "join_key2", "join_key"


@dataclass(frozen=True)
class Linkage:
    """Both rosters with their keys chosen; everything about links is derived from it.

    `plain` holds the same rows, registry first, as they were before the choice of key:
    what needs no key reads them and so is spared the joins the choice takes. Rows have a
    number, which results leave out. `shared` are the ID keys of both sides, by which the key of a row is chosen; stored
    rows have no need of them. `kept` says that the rows are stored tables.
    """

    registry: DataFrame
    upload: DataFrame
    plain: tuple[DataFrame, DataFrame]
    cfg: MatchConfig
    tables: tuple[str, ...] = ()
    kept: bool = False
    counted: HotKeys | None = None
    shared: DataFrame | None = None

    @cached_property
    def hot(self) -> HotKeys:
        """The keys of which pairs cannot be formed in one task. Counted, by a job, when first asked for: what looks
        rows up by key has no need of it."""
        if self.counted is not None:
            return self.counted
        return HotKeys.find([(rows, [ID_KEY, NAME_KEY]) for rows in self.plain], self.cfg.limits)

    def rows(self, side: Side) -> DataFrame:
        return self.registry if side == self.cfg.registry else self.upload

    def other(self, side: Side) -> DataFrame:
        return self.upload if side == self.cfg.registry else self.registry

    def plain_rows(self, side: Side) -> DataFrame:
        return self.plain[self.cfg.sides.index(side)]

    def stored(self, folder: str) -> "Linkage":
        """Write both keyed rosters as Parquet and go on from there.

        For jobs that draw several results from one linkage: the keys are then worked out
        once, and a lost executor costs no more than re-reading files. The tables are
        bucketed by the chosen key, so no join or count by key shuffles the rows again;
        only with hot keys they are not, as a bucket cannot be spread. `folder` must be on
        storage all executors share. `release` takes the tables out of the catalog.
        """
        spark = self.registry.sparkSession
        kept, tables = {}, []
        for name in ("registry", "upload"):
            df, path = getattr(self, name), f"{folder}/{name}"
            if self.hot:
                df.write.parquet(path)
                kept[name] = spark.read.parquet(path)
                continue
            df = df.drop(ROW)
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            table = f"rosterloom_{name}_{uuid.uuid4().hex}"
            (df.repartition(buckets, KEY).write.format("parquet").option("path", path)
             .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table))
            kept[name] = spark.table(table)
            tables.append(table)
        return replace(self, **kept, plain=(kept["registry"], kept["upload"]), tables=tuple(tables),
                       kept=True, counted=self.hot, shared=None)

    def release(self) -> None:
        """Forget stored tables. Their files stay; results not computed yet need them."""
        for table in self.tables:
            self.registry.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def add_keys(df: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Both candidate keys of a row, as text."""

    def key(names: list[str], keep_missing: bool):
        return text_key([F.col(side.col(n)) for n in names], cfg.key_separator,
                        cfg.missing_text, keep_missing)

    return df.withColumns({
        ID_KEY: key([cfg.district, cfg.student_id], True),
        NAME_KEY: key([cfg.district, cfg.first_name, cfg.last_name, cfg.birth_date],
                      cfg.match_missing_names),
    })


def shared_ids(registry: DataFrame, upload: DataFrame) -> DataFrame:
    """The ID keys that both rosters have, by one count with a bit for each side."""
    sides = [rows.select(ID_KEY, F.lit(bit).alias("_sides")) for rows, bit in ((registry, 1), (upload, 2))]
    masks = sides[0].unionAll(sides[1]).groupBy(ID_KEY).agg(F.bit_or("_sides").alias("_sides"))
    return masks.filter(F.col("_sides") == 3).select(ID_KEY, F.lit(True).alias("_known"))


def chosen_key() -> Column:
    return F.when(F.col("_known"), F.col(ID_KEY)).otherwise(F.col(NAME_KEY))


def choose_key(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The ID key where the other roster knows it, the name key otherwise.

    A lookup has one row per key; adaptive execution splits what a crowded key makes too large.
    """
    return rows.join(shared, ID_KEY, "left").withColumn(KEY, chosen_key()).drop("_known")


def link_rosters(registry: DataFrame, upload: DataFrame,
                 cfg: MatchConfig = MatchConfig()) -> Linkage:
    """Restrict the clean registry roster to the batch, then choose a key for every row."""
    registry = restrict_to_batch(with_row_numbers(registry), upload, cfg)
    registry = add_keys(registry, cfg.registry, cfg)
    upload = add_keys(with_row_numbers(upload), cfg.upload, cfg)
    shared = shared_ids(registry, upload)
    return Linkage(choose_key(registry, shared), choose_key(upload, shared), (registry, upload), cfg, shared=shared)


def rows_under(link: Linkage, side: Side, keys: DataFrame) -> DataFrame:
    """The rows of one side whose key is among `keys`, with all columns; `keys` has one row per key and
    may add columns.

    The lookup by ID key, which whole rows are shuffled for, also tells whether a row known by its ID is wanted. Only
    the rows that are, and those known by name, are shuffled again by the key chosen. Name keys are spelt after either.
    """
    if link.shared is None:
        return link.rows(side).drop(ROW).join(keys, KEY)
    told = link.shared.join(keys.select(F.col(KEY).alias(ID_KEY), F.lit(True).alias("_wanted")), ID_KEY, "left")
    rows = link.plain_rows(side).drop(ROW, NAME_KEY).join(told, ID_KEY, "left")
    rows = add_keys(rows.filter("_known IS NULL OR _wanted"), side, link.cfg)
    found = rows.withColumn(KEY, chosen_key()).drop("_known", "_wanted", ID_KEY, NAME_KEY).join(keys, KEY)
    return add_keys(found, side, link.cfg)


def key_counts(rows: DataFrame, name: str = "n") -> DataFrame:
    """Rows per key. Rows without a key (a switched-off name match) have none."""
    return rows.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias(name))


def link_sizes(link: Linkage) -> DataFrame:
    """One row per linked key: rows on each side. The compact form of the linked pairs."""
    return key_counts(link.registry, "n_p").join(key_counts(link.upload, "n_s"), KEY, "inner")


def linked_pairs(link: Linkage) -> DataFrame:
    """Every linked pair with all columns of both sides; the join is many-to-many.

    This is the one result whose size is the number of pairs. Counts over pairs come
    from `pair_counts`, which does not form the pairs of crowded keys.
    """
    p, s = (link.rows(side).withColumnsRenamed({k: f"{k}_{suffix}" for k in (ID_KEY, NAME_KEY)})
            for side, suffix in zip(link.cfg.sides, "ps"))
    return link.hot.join_pairs(p, s, KEY)


def linked_distinct_pairs(link: Linkage) -> DataFrame:
    """The linked pairs of distinct rows, and how many copies of either row there are.

    Says the same as `linked_pairs` in one row per n_p · n_s pairs. Copies are counted
    before the join, so a large group of them costs one row.
    """
    distinct = []
    for side, n, suffix in zip(link.cfg.sides, ("n_p", "n_s"), "ps"):
        rows = link.rows(side).drop(ROW)
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(n))
        if link.hot:
            # No copies are left, so the content of a row can number it.
            rows = rows.withColumn(ROW, F.xxhash64(*rows.columns))
        distinct.append(rows.withColumnsRenamed({k: f"{k}_{suffix}" for k in (ID_KEY, NAME_KEY)}))
    return link.hot.join_pairs(*distinct, KEY)


def unmatched(link: Linkage, side: Side) -> DataFrame:
    """Rows of one side, with all columns, whose key the other side does not have.

    A row whose ID both sides know is linked by it. So only the others are looked up by the key chosen, their name
    key, and shuffled for it.
    """
    known = link.other(side).select(KEY).distinct()
    if link.shared is None:
        return link.rows(side).join(known, KEY, "left_anti").drop(ROW)
    rows = link.plain_rows(side).drop(ROW, NAME_KEY).join(link.shared, ID_KEY, "left_anti")
    named = add_keys(rows, side, link.cfg).withColumn(KEY, F.col(NAME_KEY)).drop(ID_KEY, NAME_KEY)
    return add_keys(named.join(known, KEY, "left_anti"), side, link.cfg)


def duplicate_keys(link: Linkage, side: Side) -> DataFrame:
    """Keys that occur more than once on one side, with the number of rows."""
    return key_counts(link.rows(side)).filter(F.col("n") > 1)


def duplicate_key_rows(link: Linkage) -> DataFrame:
    """Upload rows linked to a key that is duplicated in the registry, one-to-many included."""
    dups = duplicate_keys(link, link.cfg.registry)
    return rows_under(link, link.cfg.upload, dups)


def many_to_many_keys(link: Linkage) -> DataFrame:
    """Keys duplicated on both sides."""
    return link_sizes(link).filter((F.col("n_p") > 1) & (F.col("n_s") > 1))
