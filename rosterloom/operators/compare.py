"""Comparing linked pairs field by field, row by row."""

from __future__ import annotations

from dataclasses import replace

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.functions.jaro import jaro, jaro_where
from rosterloom.functions.text import is_filled, standardize_address, tidy
from rosterloom.operators.link import KEY, Linkage, linked_pairs
from rosterloom.operators.skew import ROW

SCHOOL, PARENT, ADDRESS, CASE = "school_code", "parent_name", "address", "case_number"
FIELDS = (SCHOOL, PARENT, ADDRESS, CASE)


def count_name(field: str) -> str:
    return f"{field}_mismatch_count"


def value_names(field: str) -> tuple[str, ...]:
    """The values a field is made of."""
    return ("parent_first", "parent_last") if field == PARENT else (field,)


def comparable(df: DataFrame, side: Side, cfg: MatchConfig, fields: list[str],
               extra: tuple[str, ...] = ()) -> DataFrame:
    """One roster reduced to what comparing these fields reads, named by the side's short name.

    Texts are normalised here, once per row, and not once per pair.
    """
    def at(name: str) -> Column:
        return F.col(side.col(name))

    address = F.when(is_filled(at(cfg.address)), standardize_address(at(cfg.address)))
    values = {
        "elig": F.lower(at(cfg.eligibility)),
        SCHOOL: at(cfg.school_code),
        "parent_first": tidy(at(cfg.parent_first)),
        "parent_last": tidy(at(cfg.parent_last)),
        CASE: at(cfg.case_number),
        ADDRESS: address,
    }
    kept = [F.col(c) for c in (KEY, *extra)]
    if ROW in df.columns:
        kept.append(F.col(ROW))
    if side == cfg.upload:
        kept.append(at(cfg.district).alias("AUN"))
    return df.select(*kept, *[values[n].alias(f"{side.short}_{n}") for f in fields for n in value_names(f)])


def both(field: str, cfg: MatchConfig) -> tuple[Column, Column]:
    """A compared field on the registry and on the upload side of a pair."""
    return F.col(f"{cfg.registry.short}_{field}"), F.col(f"{cfg.upload.short}_{field}")


def lengths_too_far(a: Column, b: Column, threshold: float) -> Column:
    """True where the lengths alone keep the Jaro score under the threshold.

    Jaro is at most (2 + shorter/longer) / 3.
    """
    ratio = 3 * threshold - 2 - 1e-9
    return F.least(F.length(a), F.length(b)) < F.lit(ratio) * F.greatest(F.length(a), F.length(b))


def differs(field: str, cfg: MatchConfig) -> Column:
    """Whether a pair counts as a mismatch in the field; null or false if not comparable."""
    if field == PARENT:
        first, last = both("parent_first", cfg), both("parent_last", cfg)
        known = first[0].isNotNull() & first[1].isNotNull() & last[0].isNotNull() & last[1].isNotNull()
        return known & ((first[0] != first[1]) | (last[0] != last[1]))
    p, s = both(field, cfg)
    if field == ADDRESS:
        far = lengths_too_far(p, s, cfg.address_threshold)
        return far | (jaro_where((p != s) & ~far, s, p) < cfg.address_threshold)
    return p != s


def scored_pairs(link: Linkage) -> DataFrame:
    """All linked pairs with the similarity of their addresses."""
    cfg = link.cfg

    def with_standard(rows: DataFrame, side: Side) -> DataFrame:
        """Once per row, and not once per pair."""
        address = F.col(side.col(cfg.address))
        return rows.withColumn(f"_{side.short}_standard", F.when(is_filled(address), standardize_address(address)))

    standard = replace(link, registry=with_standard(link.registry, cfg.registry),
                       upload=with_standard(link.upload, cfg.upload))
    names = [f"_{side.short}_standard" for side in (cfg.upload, cfg.registry)]
    return linked_pairs(standard).withColumn("addr_similarity", jaro(*map(F.col, names))).drop(*names)


def mismatched_pairs(link: Linkage, field: str) -> DataFrame:
    """The linked pairs that differ in one field: both IDs and both values, compared form."""
    cfg = link.cfg
    p_id, s_id = cfg.registry.col(cfg.student_id), cfg.upload.col(cfg.student_id)
    p = comparable(link.registry, cfg.registry, cfg, [field], (p_id,))
    s = comparable(link.upload, cfg.upload, cfg, [field], (s_id,))
    values = [c for n in value_names(field) for c in both(n, cfg)]
    pairs = link.hot.join_pairs(p, s, KEY).filter(differs(field, cfg))
    return pairs.select("AUN", KEY, p_id, s_id, *values)
