"""Counts over linked pairs, per district, without forming the pairs of crowded keys.

Linkage is many-to-many: a key with n registry rows and m upload rows stands for n·m
pairs. Keys of few pairs are joined and counted in one pass. Keys of many pairs are
counted from the sizes of their parts:

    pairs that differ = comparable pairs − pairs that are equal
    comparable pairs  = Σ over keys   of n·m      (rows that have a value)
    equal pairs       = Σ over values of n·m      (an equi-join on key and value)

so this work grows with the rows, not with the pairs. Address similarity also counts
pairs that are close but unequal. `close_pairs` finds these through shared subsets of rare
characters and scores the candidates only; their number grows with that of the pairs that
are close, or nearly so. Every branch is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig
from rosterloom.operators.close_pairs import close_pairs
from rosterloom.operators.compare import (
    ADDRESS, FIELDS, PARENT, comparable, count_name, differs,
)
from rosterloom.operators.link import KEY, Linkage, key_counts
from rosterloom.operators.skew import ROW, broadcast_if_small
from rosterloom.workspace import work_folder

def eligibility_columns(cfg: MatchConfig) -> dict[str, tuple[str, str]]:
    """Output column → (side's short name, eligibility value), upload side first."""
    return {f"{side.prefix}_{v}": (side.short, v)
            for side in (cfg.upload, cfg.registry) for v in cfg.eligibility_values}


def pair_counts(link: Linkage, fields: tuple[str, ...] = FIELDS, eligibility: bool = True) -> DataFrame:
    """One row per district with linked pairs, and the requested counts over its pairs."""
    cfg = link.cfg
    needed = [*(["elig"] if eligibility else []), *fields]
    p, s = _kept(link, [comparable(link.rows(side), side, cfg, needed).drop(ROW) for side in cfg.sides])
    crowded = crowded_keys(p, s, cfg)
    if crowded is None:
        return _count_pairs(p.join(s, KEY), cfg, fields, eligibility)

    (p_few, p_many), (s_few, s_many) = (
        [df.join(crowded, KEY, how) for how in ("left_anti", "left_semi")] for df in (p, s))
    parts = [_count_pairs(p_few.join(s_few, KEY), cfg, fields, eligibility)]
    if fields:
        parts.append(_count_by_sizes(p_many, s_many, cfg, fields))
    if eligibility:
        parts.append(_eligibility_by_sizes(p_many, s_many, cfg))
    wanted = [*(eligibility_columns(cfg) if eligibility else ()), *map(count_name, fields)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.groupBy("AUN").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in wanted])


def _kept(link: Linkage, rows: list[DataFrame]) -> list[DataFrame]:
    """Both sides as stored tables, written by one job; those of a stored linkage are it already.

    Several aggregations read them, and which ones depends on the keys.
    """
    if link.kept:
        return rows
    spark, sides = rows[0].sparkSession, link.cfg.sides
    folder = work_folder(spark, "pairs")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        df.withColumn("_side", F.lit(side.short)) for side, df in zip(sides, rows)])
    both.write.partitionBy("_side").parquet(folder)
    stored = spark.read.schema(both.schema).parquet(folder)
    return [stored.filter(F.col("_side") == side.short).select(df.columns) for side, df in zip(sides, rows)]


def crowded_keys(p: DataFrame, s: DataFrame, cfg: MatchConfig) -> DataFrame | None:
    """The keys that stand for more than `pair_limit` pairs, stored, marked for broadcast if small; None without any."""
    spark, limits = p.sparkSession, cfg.limits
    sizes = key_counts(p, "n_p").join(key_counts(s, "n_s"), KEY, "inner")
    crowded = sizes.filter(F.col("n_p").cast("double") * F.col("n_s") > limits.pair_limit).select(KEY)
    folder = work_folder(spark, "crowded")
    crowded.write.parquet(folder)
    listed = spark.read.schema(crowded.schema).parquet(folder)
    return None if listed.isEmpty() else broadcast_if_small(listed, limits)


def _count_pairs(pairs: DataFrame, cfg: MatchConfig, fields: tuple[str, ...],
                 eligibility: bool) -> DataFrame:
    """Count all measures over formed pairs in one pass."""
    measures = {}
    if eligibility:
        for name, (short, value) in eligibility_columns(cfg).items():
            measures[name] = F.col(f"{short}_elig") == value
    for f in fields:
        measures[count_name(f)] = differs(f, cfg)
    flagged = pairs.select("AUN", *[test.alias(name) for name, test in measures.items()])
    return flagged.groupBy("AUN").agg(*[F.count_if(name).alias(name) for name in measures])


def _product() -> Column:
    """Pairs of a group, wide enough for the square of any row count."""
    return F.sum(F.col("np").cast("decimal(19,0)") * F.col("ns").cast("decimal(19,0)"))


def _eligibility_by_sizes(p: DataFrame, s: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Each value of one side counts once for every row of the key on the other side."""
    one_side = {}
    for side, rows, by in ((cfg.registry, p, [KEY]), (cfg.upload, s, [KEY, "AUN"])):
        elig = F.col(f"{side.short}_elig")
        one_side[side] = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias(f"{side.short}_all"),
            *[F.count_if(elig == v).alias(f"{side.prefix}_{v}") for v in cfg.eligibility_values])
    other_all = {cfg.registry.short: f"{cfg.upload.short}_all", cfg.upload.short: f"{cfg.registry.short}_all"}
    joined = one_side[cfg.registry].join(one_side[cfg.upload], KEY, "inner")
    return joined.groupBy("AUN").agg(*[
        F.sum(F.col(name).cast("decimal(19,0)") * F.col(other_all[short]).cast("decimal(19,0)"))
        .cast("decimal(38,0)").alias(name)
        for name, (short, _) in eligibility_columns(cfg).items()])


def _values(rows: DataFrame, short: str, by: list[str], fields: tuple[str, ...], n: str) -> DataFrame:
    """Rows per key, field and value; fields without a value are left out."""
    def value(field: str) -> Column:
        if field == PARENT:
            first, last = F.col(f"{short}_parent_first"), F.col(f"{short}_parent_last")
            # The length keeps ('ab', 'c') and ('a', 'bc') apart; null if either is null.
            return F.concat(F.length(first).cast("string"), F.lit(":"), first, last)
        return F.col(f"{short}_{field}")

    each = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
    return (rows.select(*by, F.inline(each))
            .filter(F.col("value").isNotNull())
            .groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias(n)))


def _count_by_sizes(p: DataFrame, s: DataFrame, cfg: MatchConfig, fields: tuple[str, ...]) -> DataFrame:
    pv = _values(p, cfg.registry.short, [KEY], fields, "np")
    sv = _values(s, cfg.upload.short, [KEY, "AUN"], fields, "ns")

    p_rows = pv.groupBy(KEY, "field").agg(F.sum("np").alias("np"))
    s_rows = sv.groupBy(KEY, "AUN", "field").agg(F.sum("ns").alias("ns"))
    comparable_pairs = p_rows.join(s_rows, [KEY, "field"]).groupBy("AUN", "field").agg(_product().alias("n"))
    equal_pairs = pv.join(sv, [KEY, "field", "value"]).groupBy("AUN", "field").agg(_product().alias("n"))

    minus = [equal_pairs]
    if ADDRESS in fields:
        minus.append(_close_pairs(pv, sv, cfg))
    signed = reduce(DataFrame.unionByName, [comparable_pairs] + [
        m.withColumn("n", -F.col("n")) for m in minus])
    return signed.groupBy("AUN").agg(*[
        F.sum(F.when(F.col("field") == f, F.col("n"))).cast("decimal(38,0)").alias(count_name(f))
        for f in fields])


def _close_pairs(pv: DataFrame, sv: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Pairs of unequal addresses of one key that reach the threshold, counted per district."""
    p, s = (values.filter(F.col("field") == ADDRESS).drop("field") for values in (pv, sv))
    close = close_pairs(p, s, cfg)
    return close.groupBy("AUN").agg(_product().alias("n")).withColumn("field", F.lit(ADDRESS))
