"""District summary: head counts, ID lengths, eligibility and mismatches, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.functions.text import id_length_flag
from rosterloom.operators.clean import prefix_columns
from rosterloom.operators.compare import FIELDS, count_name
from rosterloom.operators.link import Linkage
from rosterloom.operators.pair_counts import eligibility_columns, pair_counts


def zero_filled(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def side_counts(rows: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Per district of one side: rows, IDs of the expected length, other IDs. One pass."""
    flag = id_length_flag(F.col(side.col(cfg.student_id)), cfg.id_length)
    return (rows.select(F.col(side.col(cfg.district)).alias("AUN"), flag.alias("flag"))
            .groupBy("AUN").agg(
                F.count(F.lit(1)).alias(f"{side.short}_total"),
                F.count_if(F.col("flag") == "TRUE").alias(f"{side.short}{cfg.id_length}digit_pasecureIDs"),
                F.count_if(F.col("flag") != "TRUE").alias(f"{side.short}_not_pasecure")))


def _both_sides(registry: DataFrame, upload: DataFrame, cfg: MatchConfig) -> DataFrame:
    p, s = side_counts(registry, cfg.registry, cfg), side_counts(upload, cfg.upload, cfg)
    return p.join(s, "AUN", "full")


def _difference(cfg: MatchConfig):
    return F.col(f"{cfg.registry.short}_total") - F.col(f"{cfg.upload.short}_total")


def head_counts(registry: DataFrame, upload: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Rows per district on each side, 0 where there is none, and registry − upload."""
    counts = zero_filled(_both_sides(registry, upload, cfg))
    totals = [f"{side.short}_total" for side in cfg.sides]
    return counts.select("AUN", *totals, _difference(cfg).alias("difference"))


def id_lengths(registry: DataFrame, upload: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """IDs of the expected length and others, per district and side; null for an absent side."""
    return _both_sides(registry, upload, cfg).select("AUN", *_id_columns(cfg))


def id_length_rows(rows: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Every row of one side with its ID-length flag."""
    name = f"{side.short}{cfg.id_length}digitID"
    return rows.withColumn(name, id_length_flag(F.col(side.col(cfg.student_id)), cfg.id_length))


def odd_ids(rows: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """The rows of one side, with all columns, whose ID has not the expected length, and its length."""
    name = f"{side.short}{cfg.id_length}digitID"
    return id_length_rows(rows, side, cfg).filter(F.col(name) != "TRUE")


def _id_columns(cfg: MatchConfig) -> list[str]:
    return [c for side in cfg.sides
            for c in (f"{side.short}{cfg.id_length}digit_pasecureIDs", f"{side.short}_not_pasecure")]


def count_eligibility(df: DataFrame, district: str, column: str, prefix: str,
                      values: tuple[str, ...] = MatchConfig.eligibility_values) -> DataFrame:
    """Rows per district and countable value, one column per value, named by a prefix.

    Works on any frame. Values are lowered, not trimmed. Every value has its column, seen
    or not; districts without a countable row do not appear.
    """
    elig = F.lower(F.col(column))
    wide = (df.select(F.col(district).alias("AUN"), elig.alias("elig"))
            .filter(F.col("elig").isin(*values))
            .groupBy("AUN").agg(*[F.count_if(F.col("elig") == v).alias(v) for v in values]))
    return prefix_columns(wide, prefix, keep=("AUN",))


def with_eligibility_differences(counts: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Upload − registry per eligibility value.

    A side without any countable value in a district has no eligibility row there, so the
    differences of that district are null (and 0 in the summary), not the other side's count.
    """
    def seen(side: Side):
        return sum((F.col(f"{side.prefix}_{v}") for v in cfg.eligibility_values), F.lit(0)) > 0

    paired = seen(cfg.registry) & seen(cfg.upload)
    return counts.withColumns({
        f"diff_{v}": F.when(paired, F.col(f"{cfg.upload.prefix}_{v}") - F.col(f"{cfg.registry.prefix}_{v}"))
        for v in cfg.eligibility_values})


def eligibility_wide(link: Linkage) -> DataFrame:
    """Eligibility counts over linked pairs, both sides, with differences.

    Districts without a countable value on either side do not appear; on a side without
    one the counts are null.
    """
    cfg = link.cfg
    counts = with_eligibility_differences(pair_counts(link, fields=()), cfg)
    out = counts
    for side in cfg.sides:
        names = [f"{side.prefix}_{v}" for v in cfg.eligibility_values]
        seen = sum((F.col(n) for n in names), F.lit(0)) > 0
        out = out.withColumn(f"_{side.short}", seen)
    out = out.filter(F.col(f"_{cfg.registry.short}") | F.col(f"_{cfg.upload.short}"))
    for side in cfg.sides:
        out = out.withColumns({n: F.when(F.col(f"_{side.short}"), F.col(n)) for n in
                               (f"{side.prefix}_{v}" for v in cfg.eligibility_values)})
    return out.drop(*(f"_{side.short}" for side in cfg.sides))


def mismatch_counts(link: Linkage, field: str) -> DataFrame:
    """Mismatching pairs per district in one field; districts without any do not appear."""
    counts = pair_counts(link, fields=(field,), eligibility=False)
    return counts.filter(F.col(count_name(field)) > 0)


def district_summary(link: Linkage) -> DataFrame:
    """One row per district of the batch, sorted, with all counts; 0 where there is nothing.

    Each side is aggregated once and the pairs once; what is joined has one row per district.
    """
    cfg = link.cfg
    sides = _both_sides(*link.plain, cfg)
    pairs = with_eligibility_differences(pair_counts(link), cfg)
    joined = zero_filled(sides.join(pairs, "AUN", "left"))
    columns = [
        "AUN", *(f"{side.short}_total" for side in cfg.sides), _difference(cfg).alias("difference"),
        *eligibility_columns(cfg), *(f"diff_{v}" for v in cfg.eligibility_values),
        *_id_columns(cfg), *map(count_name, FIELDS),
    ]
    return joined.select(*columns).orderBy(F.asc_nulls_last("AUN"))
