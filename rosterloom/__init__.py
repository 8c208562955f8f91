"""Linking two large rosters and reporting, per district, how far they disagree."""

from rosterloom.config import MatchConfig, ScaleLimits, Side
from rosterloom.operators.link import Linkage, link_rosters
from rosterloom.plans.batch import batch_results, build_registry_snapshot, prepare, run_batch
from rosterloom.plans.summary import district_summary
from rosterloom.sources.csv_folder import read_roster_folder

__all__ = [
    "Linkage", "MatchConfig", "ScaleLimits", "Side", "batch_results", "build_registry_snapshot",
    "district_summary", "link_rosters", "prepare", "read_roster_folder", "run_batch",
]
