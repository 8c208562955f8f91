"""Names, thresholds and scale limits of one matching job."""

from __future__ import annotations

from dataclasses import dataclass, field

# The 25 roster columns, in file order. Names are assigned by position.
ROSTER_COLUMNS = (
    "sfa_name", "aun9_3", "school_name", "school_code4", "pasecureid",
    "student_first_name", "student_middle_name", "student_last_name", "student_dob",
    "student_address1", "student_address2", "student_apt_no", "student_city",
    "student_state", "student_zip", "eligibility", "county", "case_number",
    "parent_first_name", "parent_last_name", "parent_phone", "parent_email",
    "enrollment_begin", "enrollment_end", "validation_output",
)

# The columns that are trimmed and lower-cased before matching.
KEY_COLUMNS = (
    "aun9_3", "pasecureid", "student_dob", "student_last_name", "student_first_name",
    "parent_first_name", "parent_last_name",
)

# The countable eligibility categories, in output order.
ELIGIBILITY_VALUES = ("free", "paid", "reduced")


@dataclass(frozen=True)
class Side:
    """One of the two rosters: its column prefix, its label and its count prefix."""

    prefix: str
    label: str
    short: str

    def col(self, name: str) -> str:
        return f"{self.prefix}_{name}"


@dataclass(frozen=True)
class ScaleLimits:
    """Where the plans change shape. None of these changes a result.

    listed_districts  up to so many districts of a batch are written into the filter
    broadcast_bytes   a set is broadcast only if its measured size is at most this
    slice_rows        a key with more rows than this on a side goes to slices of about this size
    slice_pairs       of a key with more pairs than this, slices that meet have about so many at most
    pair_limit        keys with more pairs than this are counted without forming pairs
    cross_pairs       a key with more pairs than this is joined by itself, as the product of its rows
    cross_keys        up to so many keys, those of most pairs, are; the others go to slices
    """

    listed_districts: int = 1_000
    broadcast_bytes: int = 8 * 1024 * 1024
    slice_rows: int = 1_000_000
    slice_pairs: int = 100_000_000
    pair_limit: int = 10_000
    cross_pairs: int = 10_000_000
    cross_keys: int = 16

    def __post_init__(self):
        if min(self.slice_rows, self.slice_pairs, self.pair_limit, self.cross_pairs) < 1:
            raise ValueError("slice_rows, slice_pairs, pair_limit and cross_pairs must be positive")


# Prefix, label and count prefix of both sides, as results spell them.
REGISTRY_SIDE = Side("primero", "Primero", "p")
UPLOAD_SIDE = Side("sebt", "SEBT", "s")


@dataclass(frozen=True)
class MatchConfig:
    """What is matched and how. The defaults give the results their usual names."""

    registry: Side = REGISTRY_SIDE
    upload: Side = UPLOAD_SIDE
    key_columns: tuple[str, ...] = KEY_COLUMNS
    district: str = "aun9_3"
    student_id: str = "pasecureid"
    first_name: str = "student_first_name"
    last_name: str = "student_last_name"
    birth_date: str = "student_dob"
    address: str = "student_address1"
    eligibility: str = "eligibility"
    school_code: str = "school_code4"
    case_number: str = "case_number"
    parent_first: str = "parent_first_name"
    parent_last: str = "parent_last_name"
    eligibility_values: tuple[str, ...] = ELIGIBILITY_VALUES
    id_length: int = 10
    address_threshold: float = 0.9
    key_separator: str = "_"
    missing_text: str = "NA"
    match_missing_names: bool = True
    limits: ScaleLimits = field(default_factory=ScaleLimits)

    def __post_init__(self):
        # Below 2/3 a Jaro score no longer bounds the lengths of the two texts, which
        # the exact candidate search for crowded keys relies on.
        if not 2 / 3 < self.address_threshold <= 1:
            raise ValueError("address_threshold must lie above 2/3 and at most 1")
        if not self.key_separator:
            raise ValueError("key_separator must not be empty")

    @property
    def sides(self) -> tuple[Side, Side]:
        return self.registry, self.upload
