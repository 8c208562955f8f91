"""The whole job: snapshot the registry once, then match one batch of uploads after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.config import MatchConfig, Side
from rosterloom.operators.clean import clean_roster, prefix_columns
from rosterloom.operators.compare import FIELDS, mismatched_pairs, scored_pairs
from rosterloom.operators.exceptions import one_sided_ids
from rosterloom.operators.link import (
    ID_KEY, KEY, NAME_KEY, Linkage, duplicate_key_rows, duplicate_keys, link_rosters, link_sizes, many_to_many_keys, unmatched,
)
from rosterloom.operators.resolve import resolve, resolved_pairs, unresolved_rows
from rosterloom.operators.skew import ROW
from rosterloom.plans.enrollment import enrollment_check
from rosterloom.plans.summary import district_summary, odd_ids
from rosterloom.sources.csv_folder import checked_folder, file_names, read_roster_folder, roster_cells
from rosterloom.sources.profiles import column_profiles, misplaced_columns
from rosterloom.sources.tables import load_snapshot, read_enrollment, save_snapshot, write_batch, write_named_file
from rosterloom.workspace import work_folder


def prepare(raw: DataFrame, side: Side, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """A raw roster with its prefix, clean, without the rows that cannot be matched."""
    return clean_roster(prefix_columns(raw, side.prefix), side, cfg)


def build_registry_snapshot(spark: SparkSession, folder: str, path: str,
                            cfg: MatchConfig = MatchConfig(), **reading) -> None:
    """Read the registry files and store them as the snapshot that batches load."""
    raw = read_roster_folder(spark, folder, missing_text=cfg.missing_text, **reading)
    save_snapshot(prepare(raw, cfg.registry, cfg), path, cfg.registry, cfg, mode="overwrite")


def batch_results(link: Linkage, linked: bool = False) -> dict[str, DataFrame]:
    """The results of a batch by name: the summary first, then the lists of exceptions, and on request the
    linked pairs with the similarity of their addresses."""
    cfg, resolved = link.cfg, resolve(link)
    results = {
        "district_summary": district_summary(link),
        "one_sided_ids": one_sided_ids(link),
        "unmatched_registry": unmatched(link, cfg.registry),
        "unmatched_upload": unmatched(link, cfg.upload),
        "duplicate_keys_registry": duplicate_keys(link, cfg.registry),
        "duplicate_keys_upload": duplicate_keys(link, cfg.upload),
        "duplicate_key_rows": duplicate_key_rows(link),
        "many_to_many_keys": many_to_many_keys(link),
        "resolved_pairs": resolved_pairs(resolved),
        "unresolved_registry": unresolved_rows(resolved, cfg.registry),
        "unresolved_upload": unresolved_rows(resolved, cfg.upload),
        "link_sizes": link_sizes(link),
        **{f"odd_ids_{name}": odd_ids(link.plain_rows(side).drop(ROW, ID_KEY, NAME_KEY, KEY), side, cfg)
           for name, side in (("registry", cfg.registry), ("upload", cfg.upload))},
        **{f"{field}_mismatch_pairs": mismatched_pairs(link, field) for field in FIELDS},
    }
    return results | ({"linked_pairs": scored_pairs(link)} if linked else {})


def run_batch(spark: SparkSession, snapshot: str, upload_folder: str, out: str, batch: str,
              cfg: MatchConfig = MatchConfig(), form: str = "parquet", *, linked: bool = False,
              enrollment: str | None = None, enrollment_form: str = "parquet", **reading) -> dict[str, str]:
    """Match one folder of uploads against the snapshot and write all results.

    The uploads are parsed once and the keys chosen once: both are kept as Parquet on
    shared storage, from where every result is computed. `misplaced_columns` says in which files columns do not look like
    what they should hold. `linked` asks for the linked pairs, `enrollment` names the official table and asks for the check
    against it. The summary is also written as one file, `<batch>_district_summary.csv`.
    """
    work, out = work_folder(spark, f"batch-{batch}"), out.rstrip("/")
    parsed = checked_folder(spark, upload_folder, **reading)
    raw = roster_cells(parsed, missing_text=cfg.missing_text)
    prepare(raw, cfg.upload, cfg).write.parquet(f"{work}/upload-clean")
    upload = spark.read.parquet(f"{work}/upload-clean")
    misplaced = misplaced_columns(column_profiles(parsed)).join(file_names(spark, upload_folder), "_file").drop("_file")
    link = link_rosters(load_snapshot(spark, snapshot), upload, cfg).stored(f"{work}/keyed")
    try:
        results = batch_results(link, linked) | {"misplaced_columns": misplaced}
        if enrollment:
            results["enrollment_check"] = enrollment_check(raw, read_enrollment(spark, enrollment, enrollment_form))
        paths = {name: write_batch(result, f"{out}/{name}", batch, form) for name, result in results.items()}
    finally:
        link.release()
    reader = spark.read.schema(results["district_summary"].schema).option("header", True)
    summary = reader.format(form).load(paths["district_summary"]).orderBy(F.asc_nulls_last("AUN"))
    return paths | {"summary_file": write_named_file(summary, out, batch, "district_summary")}
