"""Every operator as a query over the example rosters, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom import fixtures
from rosterloom.config import MatchConfig, ScaleLimits
from rosterloom.functions.text import id_length_flag, standardize_address
from rosterloom.operators import compare
from rosterloom.operators.clean import clean_roster, restrict_to_batch
from rosterloom.operators.exceptions import id_list, one_sided_ids
from rosterloom.operators.link import (
    KEY, Linkage, duplicate_key_rows, duplicate_keys, link_rosters, link_sizes,
    linked_distinct_pairs, linked_pairs, many_to_many_keys, unmatched,
)
from rosterloom.operators.resolve import resolve, resolved_pairs, unresolved_rows
from rosterloom.plans import summary
from rosterloom.plans.batch import prepare
from rosterloom.plans.enrollment import district_count, enrollment_check
from rosterloom.sources.csv_folder import file_widths, parsed_folder, read_roster_folder
from rosterloom.sources.profiles import column_profiles, misplaced_columns
from rosterloom.sources.tables import load_snapshot, read_enrollment, save_snapshot, write_batch
from rosterloom.workspace import work_folder

CFG = MatchConfig()

# For the crowded rosters: limits low enough for the small tables to take the plans for
# hot keys, crowded keys and long district lists.
CROWDED = replace(CFG, limits=ScaleLimits(
    listed_districts=1, broadcast_bytes=1, slice_rows=5, slice_pairs=50, pair_limit=100))
NAMED_ONLY = replace(CFG, match_missing_names=False)

Query = Callable[[SparkSession, str], DataFrame]
_snapshots: dict[tuple, str] = {}


def clean_rosters(spark: SparkSession, sf_dir: str, cfg: MatchConfig = CFG) -> tuple[DataFrame, DataFrame]:
    recipes = {}
    if cfg is CROWDED:
        recipes = {cfg.registry: fixtures.CROWDED_REGISTRY, cfg.upload: fixtures.CROWDED_UPLOAD}
    registry = fixtures.registry_roster(spark, sf_dir, recipes.get(cfg.registry, fixtures.REGISTRY))
    upload = fixtures.upload_roster(spark, sf_dir, recipes.get(cfg.upload, fixtures.UPLOAD))
    return clean_roster(registry, cfg.registry, cfg), clean_roster(upload, cfg.upload, cfg)


def snapshots(spark: SparkSession, sf_dir: str, cfg: MatchConfig = CFG) -> tuple[DataFrame, DataFrame]:
    """Both clean rosters as stored tables, made once per session and source folder."""
    known = (spark.sparkContext.applicationId, sf_dir, cfg is CROWDED)
    if known not in _snapshots:
        folder = work_folder(spark, "rosters")
        registry, upload = clean_rosters(spark, sf_dir, cfg)
        save_snapshot(registry, f"{folder}/registry", cfg.registry, cfg)
        upload.write.parquet(f"{folder}/upload")
        _snapshots[known] = folder
    folder = _snapshots[known]
    return load_snapshot(spark, f"{folder}/registry"), spark.read.parquet(f"{folder}/upload")


def linked(spark: SparkSession, sf_dir: str, cfg: MatchConfig = CFG) -> Linkage:
    return link_rosters(*snapshots(spark, sf_dir, cfg), cfg)


def _stack(parts: dict) -> DataFrame:
    """One frame per side under common names, labelled."""
    out = None
    for side, df in parts.items():
        plain = df.withColumnsRenamed({c: c.removeprefix(f"{side.prefix}_") for c in df.columns})
        plain = plain.withColumn("Source", F.lit(side.label))
        out = plain if out is None else out.unionByName(plain)
    return out


def _clean(spark, sf_dir):
    return _stack(dict(zip(CFG.sides, clean_rosters(spark, sf_dir))))


def _semi_join(cfg=CFG):
    def query(spark, sf_dir):
        return restrict_to_batch(*snapshots(spark, sf_dir, cfg), cfg)
    return query


def _id_lists(spark, sf_dir):
    rosters = zip(CFG.sides, snapshots(spark, sf_dir))
    return _stack({side: id_list(df, side, CFG) for side, df in rosters})


def _keys(cfg=CFG):
    def query(spark, sf_dir):
        link = linked(spark, sf_dir, cfg)
        return _stack({side: link.rows(side).select(
            side.col(cfg.district), side.col(cfg.student_id), "join_key1", "join_key2", KEY)
            for side in cfg.sides})
    return query


def _duplicates(spark, sf_dir):
    link = linked(spark, sf_dir)
    return _stack({side: duplicate_keys(link, side) for side in CFG.sides})


def _over_link(result: Callable[..., DataFrame], *args, cfg: MatchConfig = CFG) -> Query:
    def query(spark, sf_dir):
        return result(linked(spark, sf_dir, cfg), *args)
    return query


def _over_resolved(result: Callable[..., DataFrame], *args, cfg: MatchConfig = CFG) -> Query:
    def query(spark, sf_dir):
        return result(resolve(linked(spark, sf_dir, cfg)), *args)
    return query


def _over_batch(result: Callable[..., DataFrame]) -> Query:
    def query(spark, sf_dir):
        registry, upload = snapshots(spark, sf_dir)
        return result(restrict_to_batch(registry, upload, CFG), upload, CFG)
    return query


def _id_flags(spark, sf_dir):
    rosters = zip(CFG.sides, snapshots(spark, sf_dir))
    return _stack({side: df.select(
        side.col(CFG.district), side.col(CFG.student_id),
        id_length_flag(F.col(side.col(CFG.student_id)), CFG.id_length).alias("flag"))
        for side, df in rosters})


def _eligibility(spark, sf_dir):
    counts = [summary.count_eligibility(df, side.col(CFG.district), side.col(CFG.eligibility), side.prefix)
              for side, df in zip(CFG.sides, snapshots(spark, sf_dir))]
    return counts[0].join(counts[1], "AUN", "full")


def _addresses(spark, sf_dir):
    out = {}
    for side, df in zip(CFG.sides, snapshots(spark, sf_dir)):
        address = F.col(side.col(CFG.address))
        out[side] = df.select(side.col(CFG.student_id), address, standardize_address(address).alias("standard"))
    return _stack(out)


def _similarity(link: Linkage) -> DataFrame:
    p, s = link.cfg.sides
    return compare.scored_pairs(link).select(
        KEY, p.col(CFG.student_id), s.col(CFG.student_id),
        p.col(CFG.address), s.col(CFG.address), "addr_similarity")


def _district_count(spark, sf_dir):
    return district_count(fixtures.raw_upload(spark, sf_dir), "aun9_3")


def _enrollment(spark, sf_dir):
    return enrollment_check(fixtures.raw_upload(spark, sf_dir), fixtures.official_enrollment(spark, sf_dir))


def _csv_files(df: DataFrame, encoding: str = "UTF-8") -> str:
    """`df` as a folder of CSV files whose headers do not name the columns."""
    folder = work_folder(df.sparkSession, "csv")
    (df.toDF(*[f"column {i}" for i in range(len(df.columns))]).write
     .options(header=True, escape='"', nullValue="NA", emptyValue="", encoding=encoding,
              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder))
    return folder


def _csv_roster(spark, sf_dir):
    return prepare(read_roster_folder(spark, _csv_files(fixtures.file_upload(spark, sf_dir))), CFG.upload)


def _csv_cells(read_as: str, bad_bytes: str = "replace") -> Query:
    def query(spark, sf_dir):
        folder = _csv_files(fixtures.file_upload(spark, sf_dir), "ISO-8859-1")
        return read_roster_folder(spark, folder, encoding=read_as, bad_bytes=bad_bytes, blank_as_null=("student_address2",))
    return query


def _csv_widths(spark, sf_dir):
    """Widths of three folders: as they should be, one column less, and records of several widths."""
    rows = fixtures.file_upload(spark, sf_dir)
    ragged = work_folder(spark, "csv")
    fixtures.ragged_upload(spark, sf_dir).write.options(header=True, sep="\x01", quote="\x00").csv(ragged)
    folders = {"good": _csv_files(rows), "narrow": _csv_files(rows.drop("validation_output")), "ragged": ragged}
    out = [file_widths(spark, folder).withColumn("file", F.lit(name)) for name, folder in folders.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).groupBy("file").agg(
        F.min("header_fields").alias("header_fields"), F.max("widest").alias("widest"))


def _csv_misplaced(spark, sf_dir):
    """Which columns seem to be elsewhere, in files as they should be and in files with two columns swapped."""
    rows = fixtures.file_upload(spark, sf_dir)
    at = {"aun9_3": "pasecureid", "pasecureid": "aun9_3"}
    swapped = rows.select(*[F.col(at.get(c, c)).alias(c) for c in rows.columns])
    out = []
    for name, df in (("good", rows), ("swapped", swapped)):
        parsed = parsed_folder(spark, _csv_files(df)).withColumn("_file", F.lit(name))
        out.append(misplaced_columns(column_profiles(parsed)).withColumnRenamed("_file", "file"))
    return out[0].unionAll(out[1])


def _written_summary(spark, sf_dir):
    folder = work_folder(spark, "written")
    result = summary.district_summary(linked(spark, sf_dir))
    for batch in ("batch1", "batch2", "batch1"):
        write_batch(result, folder, batch)
    return spark.read.parquet(folder)


def _enrollment_from_csv(spark, sf_dir):
    folder = work_folder(spark, "official")
    fixtures.official_enrollment(spark, sf_dir).write.option("header", True).csv(folder)
    return enrollment_check(fixtures.raw_upload(spark, sf_dir), read_enrollment(spark, folder, "csv"))


QUERIES: dict[str, Query] = {
    "clean_rosters": _clean,
    "batch_semi_join": _semi_join(),
    "batch_semi_join_crowded": _semi_join(CROWDED),
    "id_lists": _id_lists,
    "one_sided_ids": _over_link(one_sided_ids),
    "one_sided_ids_crowded": _over_link(one_sided_ids, cfg=CROWDED),
    "key_cascade": _keys(),
    "key_cascade_crowded": _keys(CROWDED),
    "key_cascade_named_only": _keys(NAMED_ONLY),
    "linked_pairs": _over_link(linked_pairs),
    "linked_pairs_crowded": _over_link(linked_pairs, cfg=CROWDED),
    "linked_distinct_pairs": _over_link(linked_distinct_pairs),
    "linked_distinct_pairs_crowded": _over_link(linked_distinct_pairs, cfg=CROWDED),
    "linked_pairs_named_only": _over_link(linked_pairs, cfg=NAMED_ONLY),
    "link_sizes": _over_link(link_sizes),
    "link_sizes_crowded": _over_link(link_sizes, cfg=CROWDED),
    "unmatched_registry": _over_link(unmatched, CFG.registry),
    "unmatched_registry_crowded": _over_link(unmatched, CFG.registry, cfg=CROWDED),
    "unmatched_upload": _over_link(unmatched, CFG.upload),
    "unmatched_upload_crowded": _over_link(unmatched, CFG.upload, cfg=CROWDED),
    "duplicate_keys": _duplicates,
    "duplicate_key_rows": _over_link(duplicate_key_rows),
    "duplicate_key_rows_crowded": _over_link(duplicate_key_rows, cfg=CROWDED),
    "many_to_many_keys": _over_link(many_to_many_keys),
    "resolved_pairs": _over_resolved(resolved_pairs),
    "resolved_pairs_crowded": _over_resolved(resolved_pairs, cfg=CROWDED),
    # In the plain rosters every row under such a key has a partner.
    "unresolved_registry": _over_resolved(unresolved_rows, CFG.registry, cfg=CROWDED),
    "unresolved_upload": _over_resolved(unresolved_rows, CFG.upload, cfg=CROWDED),
    "head_counts": _over_batch(summary.head_counts),
    "count_eligibility": _eligibility,
    "eligibility_wide": _over_link(summary.eligibility_wide),
    "eligibility_wide_crowded": _over_link(summary.eligibility_wide, cfg=CROWDED),
    "id_length_flags": _id_flags,
    "id_lengths": _over_batch(summary.id_lengths),
    "standardized_addresses": _addresses,
    "address_similarity": _over_link(_similarity),
    **{f"{f}_mismatch": _over_link(summary.mismatch_counts, f) for f in compare.FIELDS},
    **{f"{f}_mismatch_crowded": _over_link(summary.mismatch_counts, f, cfg=CROWDED)
       for f in compare.FIELDS},
    **{f"{f}_mismatch_pairs": _over_link(compare.mismatched_pairs, f) for f in compare.FIELDS},
    "district_summary": _over_link(summary.district_summary),
    "district_summary_crowded": _over_link(summary.district_summary, cfg=CROWDED),
    "district_count": _district_count,
    "enrollment_check": _enrollment,
    "enrollment_from_csv": _enrollment_from_csv,
    "csv_roster": _csv_roster,
    "csv_cells_latin1": _csv_cells("ISO-8859-1"),
    "csv_cells_bad_bytes": _csv_cells("UTF-8"),
    "csv_cells_spelt_bytes": _csv_cells("UTF-8", "spell"),
    "csv_widths": _csv_widths,
    "csv_misplaced_columns": _csv_misplaced,
    "written_summary": _written_summary,
}
