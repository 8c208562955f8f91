"""Joins that hold up when one key has a large share of the rows.

Lookups, which have one row per key, are left to adaptive execution: it splits the crowded
partitions of the rows. A many-to-many join is more than that, as its work is in the pairs. For it
`HotKeys` counts the rows of every key on both sides, exactly and pre-aggregated, and keeps a table
of the keys that are too much for one task: by their rows on a side, or by the pairs they stand
for. The rows of just these keys are spread over slices, the more of them the more slices. Keys are
known by hash here: a collision merely spreads one key more. `broadcast_if_small` broadcasts a set
only after measuring it.

A few keys may stand for nearly all pairs. Each of these is joined by itself: its pairs are the product of its rows,
which takes no sort and no copies of rows, and puts the two halves of a pair together as they are.

The slice of a row comes from its number, given where the roster is read, before any
shuffle, so a task that is run again after an executor loss puts every row in the same
slice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.config import ScaleLimits
from rosterloom.workspace import work_folder

ROW = "_row"
_HASH = "_key_hash"
# Bytes of one row of the table of hot keys, at most, once broadcast.
_ENTRY = 64
# Cells of slices that meet, for one key: enough to occupy the tasks of a large job.
_CELLS = 4096
# Of a product: pairs for a task, about; rows of the right side that a task holds while those of the left pass, at
# least and at most. A thousand rows stay in a core's cache; Spark's buffer for them spills beyond 4096.
_TASK_PAIRS, _BLOCK = 25_000_000, (1000, 4000)


def broadcast_if_small(df: DataFrame, limits: ScaleLimits) -> DataFrame:
    """Mark `df` for broadcast if its text columns, measured, fit the limit; else leave it."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    size = df.agg(F.sum(width.cast("bigint")).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= limits.broadcast_bytes else df


def with_row_numbers(df: DataFrame) -> DataFrame:
    """Number the rows of a freshly read roster."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


@dataclass(frozen=True)
class HotKeys:
    """The keys that are too much for one task: their hash and their rows on either side.

    `sizes` is a stored table, None if there are no such keys; `small` says that it may be
    broadcast. `most_pairs` is the pairs of the largest key, 0 if it is under all limits.
    `heaviest` are the hashes of the keys that are joined by themselves.
    """

    limits: ScaleLimits
    sizes: DataFrame | None = None
    small: bool = False
    most_pairs: float = 0.0
    heaviest: tuple[int, ...] = ()

    @staticmethod
    def find(sides: list[tuple[DataFrame, list[str]]], limits: ScaleLimits) -> "HotKeys":
        """Count the rows under every value of the named columns, left side and right side.

        A row counts for each of its columns, so a key chosen among them is never larger
        than its count here. One shuffle of numbers; the driver gets one row, and one for each of the heaviest keys.
        """
        counts = []
        for (df, columns), ones in zip(sides, ((1, 0), (0, 1))):
            hashes = F.explode(F.array(*[F.xxhash64(c) for c in columns]))
            counts.append(df.select(hashes.alias(_HASH), *[
                F.lit(one).cast("bigint").alias(n) for n, one in zip("nm", ones)]))
        # A null matches nothing: its rows have to be spread, but make no pairs.
        is_null = F.col(_HASH) == F.xxhash64(F.lit(None).cast("string"))
        pairs = F.when(is_null, F.lit(0.0)).otherwise(F.col("n").cast("double") * F.col("m"))
        per_key = (reduce(DataFrame.unionAll, counts).groupBy(_HASH)
                   .agg(F.sum("n").alias("n"), F.sum("m").alias("m")).withColumn("pairs", pairs))
        crowded = F.greatest("n", "m") > limits.slice_rows
        spark, folder = sides[0][0].sparkSession, work_folder(sides[0][0].sparkSession, "key-sizes")
        per_key.filter(crowded | (F.col("pairs") > min(limits.slice_pairs, limits.pair_limit, limits.cross_pairs))).write.parquet(folder)
        large = spark.read.schema(per_key.schema).parquet(folder)
        sliced = crowded | (F.col("pairs") > limits.slice_pairs)
        found = large.agg(F.count_if(sliced).alias("keys"), F.max("pairs").alias("most")).first()
        heaviest = []
        if limits.cross_keys and (found["most"] or 0.0) > limits.cross_pairs:
            # With a short side the work is in the rows, not in the pairs: such keys are left to slices.
            shortest = min(_BLOCK[0], math.isqrt(limits.cross_pairs))
            heavy = large.filter((F.col("pairs") > limits.cross_pairs) & (F.least("n", "m") >= shortest))
            heaviest = heavy.orderBy(F.desc("pairs"), _HASH).limit(limits.cross_keys).collect()
        return HotKeys(limits, large.filter(sliced) if found["keys"] else None,
                       found["keys"] * _ENTRY <= limits.broadcast_bytes, found["most"] or 0.0,
                       tuple(row[_HASH] for row in heaviest))

    def __bool__(self) -> bool:
        return self.sizes is not None

    def _grid(self) -> tuple[Column, Column]:
        """Slices of the left and of the right side, such that no two slices that meet stand for
        more pairs than the limit. Cells are square unless one side is short as it is.

        A row is copied for every slice of the other side, so slices far smaller than it takes to occupy all tasks
        would cost more than the pairs. Under low limits a key is therefore cut into `_CELLS` cells and no more, as
        long as they stay under the usual limits.
        """
        pairs, usual = F.col("pairs"), ScaleLimits()
        most = F.greatest(F.lit(float(self.limits.slice_pairs)), F.least(pairs / _CELLS, F.lit(float(usual.slice_pairs))))
        edge, cells = F.sqrt(most), F.ceil(pairs / most)
        out = []
        for mine, other in (("n", "m"), ("m", "n")):
            cut = (F.when((pairs <= most) | (F.col(mine) <= edge), F.lit(1))
                   .when(F.col(other) <= edge, cells).otherwise(F.ceil(F.col(mine) / edge)))
            rows = F.greatest(F.lit(float(self.limits.slice_rows)),
                              F.least(F.col(mine) / _CELLS ** 0.5, F.lit(float(usual.slice_rows))))
            out.append(F.greatest(cut, F.ceil(F.col(mine) / rows), F.lit(1)))
        return out[0], out[1]

    def _sized(self, df: DataFrame, key: Column, **slices: Column) -> DataFrame:
        """`df` with the named numbers of slices of its keys, 1 for keys that are not hot.

        A table too large to broadcast is joined by a shuffle, in which adaptive execution
        splits the crowded partitions of `df`.
        """
        sizes = self.sizes.select(_HASH, *[c.cast("bigint").alias(name) for name, c in slices.items()])
        out = df.withColumn(_HASH, F.xxhash64(key)).join(F.broadcast(sizes) if self.small else sizes, _HASH, "left")
        return out.withColumns({name: F.coalesce(name, F.lit(1).cast("bigint")) for name in slices}).drop(_HASH)

    @staticmethod
    def _own(slices: str) -> Column:
        return F.pmod(F.xxhash64(ROW), F.col(slices))

    @staticmethod
    def _every(slices: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(slices) - 1))

    def join_pairs(self, left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        """Many-to-many inner join: the heaviest keys one by one, all others at once, sliced."""
        if not self.heaviest:
            return self._sliced(left, right, on)
        heavy = F.xxhash64(on).isin(list(self.heaviest))
        rest = self._sliced(left.filter(~heavy), right.filter(~heavy), on)
        return reduce(DataFrame.unionAll, self._products(left.filter(heavy), right.filter(heavy), on), rest)

    def _sliced(self, left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        """Both sides of a hot key are sliced, by their rows and by their pairs, and repeated for
        the slices of the other: every two slices meet in one place, and no two stand for more
        pairs than the limit.
        """
        if not self:
            return left.drop(ROW).join(right.drop(ROW), on, "inner")
        of_left, of_right = self._grid()
        left, right = (self._sized(df, F.col(on), _lefts=of_left, _rights=of_right) for df in (left, right))
        left = left.withColumn("_left", self._own("_lefts")).withColumn("_right", self._every("_rights"))
        right = right.withColumn("_right", self._own("_rights")).withColumn("_left", self._every("_lefts"))
        left, right = (df.drop(ROW, "_lefts", "_rights") for df in (left, right))
        return left.join(right, [on, "_left", "_right"], "inner").drop("_left", "_right")

    @staticmethod
    def _products(left: DataFrame, right: DataFrame, on: str) -> list[DataFrame]:
        """For every key that both sides have: all pairs of its rows, by a product of parts of one size.

        The rows are stored, as each part is read for every part of the other side. Columns are put in order before:
        to do it for every pair costs more than forming the pair.
        """
        stored, sizes = [], []
        for df in (left, right):
            spark, folder = df.sparkSession, work_folder(df.sparkSession, "heavy-keys")
            df = df.select(on, *[c for c in df.columns if c not in (on, ROW)])
            df.write.parquet(folder)
            stored.append(spark.read.schema(df.schema).parquet(folder))
            sizes.append(dict(stored[-1].groupBy(on).count().collect()))
        out = []
        for key in sorted(sizes[0].keys() & sizes[1].keys()):
            n, m = (size[key] for size in sizes)
            block = min(max(_TASK_PAIRS // n, _BLOCK[0]), _BLOCK[1])
            lefts, rights = math.ceil(n * min(block, m) / _TASK_PAIRS), math.ceil(m / block)
            mine, others = (df.filter(F.col(on) == F.lit(key)) for df in stored)
            out.append(mine.repartition(lefts).hint("shuffle_replicate_nl").crossJoin(others.drop(on).repartition(rights)))
        return out
