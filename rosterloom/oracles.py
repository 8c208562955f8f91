"""The same queries as SQL for DuckDB, written the long way: one step, one table."""

from __future__ import annotations

from rosterloom.fixtures import FILE_UPLOAD, RAGGED, REGISTRY, UPLOAD, UPLOAD_ROWS, roster_ctes

# Fixed values, spelt out here too, so that a slip in the library shows.
KEY_COLUMNS = ("aun9_3", "pasecureid", "student_dob", "student_last_name", "student_first_name",
               "parent_first_name", "parent_last_name")
ADDRESS_WORDS = (("street", "st"), ("avenue", "ave"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"),
                 ("court", "ct"), ("place", "pl"), ("boulevard", "blvd"))

_P, _S = list(REGISTRY), list(UPLOAD)


def _cleaned(columns: list[str], prefix: str) -> str:
    keys = {f"{prefix}_{c}" for c in KEY_COLUMNS}
    return ", ".join(rf"lower(trim({c}, E' \t\r\n')) AS {c}" if c in keys else c for c in columns)


def _standard(c: str) -> str:
    out = rf"lower(trim({c}, E' \t\r\n'))"
    for word, short in ADDRESS_WORDS:
        out = rf"regexp_replace({out}, '\b{word}\b', '{short}', 'g')"
    return f"replace({out}, '.', '')"


def _keys(prefix: str, named_only: bool) -> str:
    name = [f"{prefix}_student_first_name", f"{prefix}_student_last_name", f"{prefix}_student_dob"]
    if not named_only:
        name = [f"coalesce({c}, 'NA')" for c in name]
    district = f"{prefix}_aun9_3"
    return (f"{district} || '_' || {prefix}_pasecureid AS join_key1, "
            f"{district} || '_' || {' || '.join([name[0]] + [part for c in name[1:] for part in (chr(39) + '_' + chr(39), c)])} AS join_key2")


def _common(named_only: bool = False, crowded: bool = False) -> str:
    return f"""WITH {roster_ctes(crowded)},
registry_clean AS (SELECT * FROM (SELECT {_cleaned(_P, 'primero')} FROM registry_raw)
       WHERE primero_aun9_3 <> '' AND primero_pasecureid <> ''),
upload_rows AS (SELECT * FROM (SELECT {_cleaned(_S, 'sebt')} FROM upload_raw)
       WHERE sebt_aun9_3 <> '' AND sebt_pasecureid <> ''),
registry_rows AS (SELECT * FROM registry_clean WHERE primero_aun9_3 IN (SELECT sebt_aun9_3 FROM upload_rows)),
registry_ids AS (SELECT DISTINCT primero_aun9_3 AS AUN, primero_pasecureid AS PAsecureID,
          primero_student_first_name AS FirstName, primero_student_last_name AS LastName FROM registry_rows),
upload_ids AS (SELECT DISTINCT sebt_aun9_3 AS AUN, sebt_pasecureid AS PAsecureID,
          sebt_student_first_name AS FirstName, sebt_student_last_name AS LastName FROM upload_rows),
registry_keys AS (SELECT *, {_keys('primero', named_only)} FROM registry_rows),
upload_keys AS (SELECT *, {_keys('sebt', named_only)} FROM upload_rows),
registry_keyed AS (SELECT *, CASE WHEN join_key1 IN (SELECT join_key1 FROM upload_keys) THEN join_key1 ELSE join_key2 END AS join_key FROM registry_keys),
upload_keyed AS (SELECT *, CASE WHEN join_key1 IN (SELECT join_key1 FROM registry_keys) THEN join_key1 ELSE join_key2 END AS join_key FROM upload_keys),
registry_dups AS (SELECT join_key, count(*) AS n FROM registry_keyed WHERE join_key IS NOT NULL GROUP BY join_key HAVING count(*) > 1),
upload_dups AS (SELECT join_key, count(*) AS n FROM upload_keyed WHERE join_key IS NOT NULL GROUP BY join_key HAVING count(*) > 1),
pairs AS (SELECT registry_keyed.* EXCLUDE (join_key1, join_key2), upload_keyed.* EXCLUDE (join_key1, join_key2, join_key),
           registry_keyed.join_key1 AS join_key1_p, registry_keyed.join_key2 AS join_key2_p,
           upload_keyed.join_key1 AS join_key1_s, upload_keyed.join_key2 AS join_key2_s
           FROM registry_keyed JOIN upload_keyed ON registry_keyed.join_key = upload_keyed.join_key),
standard AS (SELECT *,
             CASE WHEN primero_student_address1 <> '' THEN {_standard('primero_student_address1')} END AS p_address,
             CASE WHEN sebt_student_address1 <> '' THEN {_standard('sebt_student_address1')} END AS s_address
             FROM pairs),
scored AS (SELECT *, CASE WHEN p_address = s_address THEN 1.0::DOUBLE
           ELSE jaro_similarity(s_address, p_address) END AS addr_similarity FROM standard),
head AS (SELECT coalesce(p.AUN, s.AUN) AS AUN, coalesce(p_total, 0) AS p_total, coalesce(s_total, 0) AS s_total,
         coalesce(p_total, 0) - coalesce(s_total, 0) AS difference
         FROM (SELECT primero_aun9_3 AS AUN, count(*) AS p_total FROM registry_rows GROUP BY 1) p
         FULL JOIN (SELECT sebt_aun9_3 AS AUN, count(*) AS s_total FROM upload_rows GROUP BY 1) s ON p.AUN = s.AUN),
{_eligible('sebt')},
{_eligible('primero')},
elig AS (SELECT coalesce(s.AUN, p.AUN) AS AUN, sebt_free, sebt_paid, sebt_reduced,
         primero_free, primero_paid, primero_reduced,
         sebt_free - primero_free AS diff_free, sebt_paid - primero_paid AS diff_paid,
         sebt_reduced - primero_reduced AS diff_reduced
         FROM sebt_elig s FULL JOIN primero_elig p ON s.AUN = p.AUN),
registry_lengths AS (SELECT primero_aun9_3 AS AUN, count(*) FILTER (WHERE length(primero_pasecureid) = 10) AS "p10digit_pasecureIDs",
          count(*) FILTER (WHERE length(primero_pasecureid) <> 10) AS p_not_pasecure FROM registry_rows GROUP BY 1),
upload_lengths AS (SELECT sebt_aun9_3 AS AUN, count(*) FILTER (WHERE length(sebt_pasecureid) = 10) AS "s10digit_pasecureIDs",
          count(*) FILTER (WHERE length(sebt_pasecureid) <> 10) AS s_not_pasecure FROM upload_rows GROUP BY 1),
school_code_pairs AS (SELECT sebt_aun9_3 AS AUN, join_key, primero_pasecureid, sebt_pasecureid,
    primero_school_code4 AS p_school_code, sebt_school_code4 AS s_school_code
    FROM pairs WHERE sebt_school_code4 <> primero_school_code4),
parent_name_pairs AS (SELECT sebt_aun9_3 AS AUN, join_key, primero_pasecureid, sebt_pasecureid,
    primero_parent_first_name AS p_parent_first, sebt_parent_first_name AS s_parent_first,
    primero_parent_last_name AS p_parent_last, sebt_parent_last_name AS s_parent_last
    FROM pairs WHERE sebt_parent_first_name IS NOT NULL AND primero_parent_first_name IS NOT NULL
    AND sebt_parent_last_name IS NOT NULL AND primero_parent_last_name IS NOT NULL
    AND (lower(trim(sebt_parent_first_name)) <> lower(trim(primero_parent_first_name))
      OR lower(trim(sebt_parent_last_name)) <> lower(trim(primero_parent_last_name)))),
address_pairs AS (SELECT sebt_aun9_3 AS AUN, join_key, primero_pasecureid, sebt_pasecureid,
    p_address, s_address FROM scored WHERE addr_similarity < 0.9),
case_number_pairs AS (SELECT sebt_aun9_3 AS AUN, join_key, primero_pasecureid, sebt_pasecureid,
    primero_case_number AS p_case_number, sebt_case_number AS s_case_number
    FROM pairs WHERE sebt_case_number <> primero_case_number),
{_counted('school_code')}, {_counted('parent_name')}, {_counted('address')}, {_counted('case_number')}
"""


def _eligible(prefix: str, district: str = "sebt_aun9_3", table: str = "pairs", named: bool = True) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE e = '{v}') AS {prefix}_{v}" for v in ("free", "paid", "reduced"))
    query = (f"SELECT AUN, {counts} FROM (SELECT {district} AS AUN, lower({prefix}_eligibility) AS e "
             f"FROM {table}) WHERE e IN ('free', 'reduced', 'paid') GROUP BY AUN")
    return f"{prefix}_elig AS ({query})" if named else query


def _counted(field: str) -> str:
    return (f"{field}_counts AS (SELECT AUN, count(*) AS {field}_mismatch_count "
            f"FROM {field}_pairs GROUP BY AUN)")


def _both(p: str, s: str) -> str:
    return f"SELECT {p}, 'Primero' AS Source FROM {{p}} UNION ALL SELECT {s}, 'SEBT' AS Source FROM {{s}}"


def _bare(columns: list[str], prefix: str) -> str:
    return ", ".join(f"{c} AS {c.removeprefix(prefix + '_')}" for c in columns)


def _key_rows() -> str:
    names = "{0}_aun9_3 AS aun9_3, {0}_pasecureid AS pasecureid, join_key1, join_key2, join_key"
    return _both(names.format("primero"), names.format("sebt")).format(p="registry_keyed", s="upload_keyed")


def _outer_pair_columns() -> str:
    return ", ".join([*_P, *_S, "p.join_key", *(f"{t}.join_key{i} AS join_key{i}_{t}" for t in "ps" for i in (1, 2))])


_LENGTH = "CASE WHEN length({0}) = 10 THEN 'TRUE' ELSE CAST(length({0}) AS VARCHAR) END AS flag"

_SUMMARY = """SELECT AUN,
coalesce(p_total, 0) AS p_total, coalesce(s_total, 0) AS s_total, coalesce(difference, 0) AS difference,
coalesce(sebt_free, 0) AS sebt_free, coalesce(sebt_paid, 0) AS sebt_paid, coalesce(sebt_reduced, 0) AS sebt_reduced,
coalesce(primero_free, 0) AS primero_free, coalesce(primero_paid, 0) AS primero_paid,
coalesce(primero_reduced, 0) AS primero_reduced,
coalesce(diff_free, 0) AS diff_free, coalesce(diff_paid, 0) AS diff_paid, coalesce(diff_reduced, 0) AS diff_reduced,
coalesce("p10digit_pasecureIDs", 0) AS "p10digit_pasecureIDs", coalesce(p_not_pasecure, 0) AS p_not_pasecure,
coalesce("s10digit_pasecureIDs", 0) AS "s10digit_pasecureIDs", coalesce(s_not_pasecure, 0) AS s_not_pasecure,
coalesce(school_code_mismatch_count, 0) AS school_code_mismatch_count,
coalesce(parent_name_mismatch_count, 0) AS parent_name_mismatch_count,
coalesce(address_mismatch_count, 0) AS address_mismatch_count,
coalesce(case_number_mismatch_count, 0) AS case_number_mismatch_count
FROM head FULL JOIN elig USING (AUN) FULL JOIN registry_lengths USING (AUN) FULL JOIN upload_lengths USING (AUN)
FULL JOIN school_code_counts USING (AUN) FULL JOIN parent_name_counts USING (AUN)
FULL JOIN address_counts USING (AUN) FULL JOIN case_number_counts USING (AUN)
ORDER BY AUN NULLS LAST"""

# What each level compares, spelt out here too.
_LEVELS = (("dob", "first", "last", "school", "case_no", "address"), ("dob", "first", "last", "case_no"),
           ("dob", "first", "last", "address"), ("dob", "first", "last"), ("case_no",), ())


def _resolved(tail: str) -> str:
    """Pairs of rows that have no other partner left, level by level, from all pairs."""
    out = []
    for table, n, prefix, columns in (("registry", "n_p", "primero", _P), ("upload", "n_s", "sebt", _S)):
        values = {"dob": "student_dob", "first": "student_first_name", "last": "student_last_name",
                  "school": "school_code4", "case_no": "case_number"}
        compared = ", ".join(f"nullif(trim({prefix}_{c}), '') AS {v}" for v, c in values.items())
        out.append(f"""many_{table} AS MATERIALIZED (SELECT row_number() OVER () AS i, *, {compared},
            nullif({_standard(f"{prefix}_student_address1")}, '') AS address
            FROM (SELECT {", ".join(columns)}, join_key1, join_key2, join_key, count(*) AS {n} FROM {table}_keyed
                  WHERE join_key IN (SELECT join_key FROM registry_dups JOIN upload_dups USING (join_key)) GROUP BY ALL))""")
    for i, level in enumerate(_LEVELS, 1):
        equal = " AND ".join(f"p.{c} = s.{c}" for c in ("join_key", *level))
        free = " AND ".join(f"p.i NOT IN (SELECT p FROM level{j}) AND s.i NOT IN (SELECT s FROM level{j})"
                            for j in range(1, i)) or "TRUE"
        out.append(f"""level{i} AS MATERIALIZED (SELECT CAST({i} AS BIGINT) AS level, p.i AS p, s.i AS s
            FROM many_registry p JOIN many_upload s ON {equal} WHERE {free}
            QUALIFY count(*) OVER (PARTITION BY p.i) = 1 AND count(*) OVER (PARTITION BY s.i) = 1)""")
    levels = " UNION ALL ".join(f"SELECT * FROM level{i}" for i in range(1, len(_LEVELS) + 1))
    return ", " + ", ".join([*out, f"settled AS MATERIALIZED ({levels})"]) + " " + tail


def _unresolved(mine: str, other: str, my: str, their: str, n: str) -> str:
    compared = ", ".join(("i", n, "dob", "first", "last", "school", "case_no", "address"))
    return _resolved(f"""SELECT * EXCLUDE ({compared}), {n} AS copies,
        CASE WHEN join_key IN (SELECT join_key FROM many_{other} WHERE i NOT IN (SELECT {their} FROM settled))
        THEN 'ambiguous' ELSE 'surplus' END AS reason FROM many_{mine} WHERE i NOT IN (SELECT {my} FROM settled)""")


_ONE_SIDED = """SELECT *, 'Primero' AS Source FROM registry_ids p WHERE NOT EXISTS
(SELECT 1 FROM upload_ids s WHERE s.AUN = p.AUN AND s.PAsecureID = p.PAsecureID)
UNION ALL SELECT *, 'SEBT' AS Source FROM upload_ids s WHERE NOT EXISTS
(SELECT 1 FROM registry_ids p WHERE s.AUN = p.AUN AND s.PAsecureID = p.PAsecureID)"""

# The distinct lists of both whole snapshots, before the registry is cut to the batch.
_ID_LISTS = ("SELECT DISTINCT primero_aun9_3 AS AUN, primero_pasecureid AS PAsecureID, "
             "primero_student_first_name AS FirstName, primero_student_last_name AS LastName, "
             "'Primero' AS Source FROM registry_clean UNION ALL SELECT *, 'SEBT' AS Source FROM upload_ids")

_FIELDS = ("school_code", "parent_name", "address", "case_number")

# The queries that also run on rosters with crowded keys.
CROWDED = (
    "batch_semi_join", "one_sided_ids", "key_cascade", "linked_pairs",
    "linked_distinct_pairs", "link_sizes", "resolved_pairs", "unmatched_registry", "unmatched_upload", "duplicate_key_rows", "eligibility_wide",
    *(f"{f}_mismatch" for f in _FIELDS), "district_summary",
)

_TAILS: dict[str, str] = {
    "clean_rosters": _both(_bare(_P, "primero"), _bare(_S, "sebt")).format(p="registry_clean", s="upload_rows"),
    "batch_semi_join": "SELECT * FROM registry_rows",
    "id_lists": _ID_LISTS,
    "one_sided_ids": _ONE_SIDED,
    "key_cascade": _key_rows(),
    "linked_pairs": "SELECT * FROM pairs",
    "linked_distinct_pairs": f"""SELECT {_outer_pair_columns()}, p.n_p, s.n_s
FROM (SELECT {', '.join(_P)}, join_key1, join_key2, join_key, count(*) AS n_p FROM registry_keyed GROUP BY ALL) p
JOIN (SELECT {', '.join(_S)}, join_key1, join_key2, join_key, count(*) AS n_s FROM upload_keyed GROUP BY ALL) s
ON p.join_key = s.join_key""",
    "link_sizes": "SELECT join_key, n_p, n_s FROM (SELECT join_key, count(*) AS n_p FROM registry_keyed GROUP BY 1) "
                  "JOIN (SELECT join_key, count(*) AS n_s FROM upload_keyed GROUP BY 1) USING (join_key)",
    "unmatched_registry": "SELECT * FROM registry_keyed WHERE join_key NOT IN (SELECT join_key FROM upload_keyed)",
    "unmatched_upload": "SELECT * FROM upload_keyed WHERE join_key NOT IN (SELECT join_key FROM registry_keyed)",
    "duplicate_keys": _both("join_key, n", "join_key, n").format(p="registry_dups", s="upload_dups"),
    "duplicate_key_rows": "SELECT registry_dups.n, upload_keyed.* FROM registry_dups JOIN upload_keyed ON registry_dups.join_key = upload_keyed.join_key",
    "many_to_many_keys": "SELECT join_key, registry_dups.n AS n_p, upload_dups.n AS n_s FROM registry_dups JOIN upload_dups USING (join_key)",
    "resolved_pairs": _resolved(f"SELECT {_outer_pair_columns()}, p.n_p, s.n_s, level FROM settled "
                                "JOIN many_registry p ON p.i = settled.p JOIN many_upload s ON s.i = settled.s"),
    "unresolved_registry": _unresolved("registry", "upload", "p", "s", "n_p"),
    "unresolved_upload": _unresolved("upload", "registry", "s", "p", "n_s"),
    "head_counts": "SELECT * FROM head",
    "count_eligibility": "SELECT * FROM (" + _eligible("primero", "primero_aun9_3", "registry_clean", False) + ") FULL JOIN ("
                         + _eligible("sebt", "sebt_aun9_3", "upload_rows", False) + ") USING (AUN)",
    "eligibility_wide": "SELECT * FROM elig",
    "id_length_flags": _both(
        "primero_aun9_3 AS aun9_3, primero_pasecureid AS pasecureid, " + _LENGTH.format("primero_pasecureid"),
        "sebt_aun9_3 AS aun9_3, sebt_pasecureid AS pasecureid, " + _LENGTH.format("sebt_pasecureid"),
    ).format(p="registry_clean", s="upload_rows"),
    "id_lengths": "SELECT * FROM registry_lengths FULL JOIN upload_lengths USING (AUN)",
    "standardized_addresses": _both(
        f"primero_pasecureid AS pasecureid, primero_student_address1 AS student_address1, "
        f"{_standard('primero_student_address1')} AS standard",
        f"sebt_pasecureid AS pasecureid, sebt_student_address1 AS student_address1, "
        f"{_standard('sebt_student_address1')} AS standard").replace("FROM {p}", "FROM registry_clean").replace("FROM {s}", "FROM upload_rows"),
    "address_similarity": "SELECT join_key, primero_pasecureid, sebt_pasecureid, primero_student_address1, "
                          "sebt_student_address1, addr_similarity FROM scored",
    **{f"{f}_mismatch": f"SELECT * FROM {f}_counts" for f in _FIELDS},
    **{f"{f}_mismatch_pairs": f"SELECT * FROM {f}_pairs" for f in _FIELDS},
    "district_summary": _SUMMARY,
    "district_count": "SELECT count(*) AS n_districts FROM (SELECT DISTINCT aun9_3 FROM upload_file)",
    "enrollment_check": 'SELECT sfa_name, count(*) AS "SEBT_Count", max(Total) AS "Official_Enrollment" '
                        "FROM upload_file LEFT JOIN official ON replace(aun9_3, '-', '') "
                        "IS NOT DISTINCT FROM AUN GROUP BY sfa_name",
}


def _cells(city: str = "student_city", prefix: str = "") -> str:
    """The cells of the uploaded files as they should be read."""
    special = {"student_city": city}
    return ", ".join(f"nullif({special.get(c, c)}, 'NA') AS {prefix}{c}" for c in FILE_UPLOAD)


def _look(column: str, shape: str) -> str:
    filled = rf"coalesce(trim({column}, E' \t\r\n') <> '' AND {column} <> 'NA', FALSE)"
    return (f"count(*) FILTER ({filled}) AS filled, count(*) FILTER ({filled} AND "
            rf"regexp_full_match(trim({column}, E' \t\r\n'), '{shape}')) AS fitting")


# Looks of the columns that the example files fill, spelt out here too.
_LOOKS = {"aun9_3": "[0-9]{3}-?[0-9]{6}|[0-9]{3}-?[0-9]{3}-?[0-9]{3}", "pasecureid": "[0-9]{10}",
          "student_dob": "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
          "eligibility": "(?i)free|reduced|paid|denied|other"}


def _misplaced() -> str:
    other = {"aun9_3": "pasecureid", "pasecureid": "aun9_3"}
    tests = [f"SELECT '{file}' AS file, '{name}' AS column, {_look(other.get(name, name) if file == 'swapped' else name, shape)} "
             "FROM upload_cells" for file in ("good", "swapped") for name, shape in _LOOKS.items()]
    return ("SELECT file, \"column\", filled, fitting, CASE \"column\" WHEN 'aun9_3' THEN 'pasecureid' "
            "WHEN 'pasecureid' THEN 'aun9_3' END AS likely FROM (" + " UNION ALL ".join(tests) + ") WHERE 2 * fitting < filled")


_MISPLACED = _misplaced()
_FILE = [f"sebt_{c}" for c in FILE_UPLOAD]
_BLANK_AS_NULL = "* REPLACE (nullif(student_address2, '') AS student_address2)"
_TAILS |= {
    "csv_roster": f"SELECT * FROM (SELECT {_cleaned(_FILE, 'sebt')} FROM (SELECT {_cells(prefix='sebt_')} "
                  "FROM upload_cells)) WHERE sebt_aun9_3 <> '' AND sebt_pasecureid <> ''",
    "csv_cells_latin1": f"SELECT {_BLANK_AS_NULL} FROM (SELECT {_cells()} FROM upload_cells)",
    "csv_cells_bad_bytes": f"SELECT {_BLANK_AS_NULL} FROM (SELECT "
                           + _cells("regexp_replace(student_city, '[Æøé]', chr(65533), 'g')") + " FROM upload_cells)",
    "csv_cells_spelt_bytes": f"SELECT {_BLANK_AS_NULL} FROM (SELECT "
                             + _cells("replace(replace(replace(student_city, 'Æ', '<c6>'), 'ø', '<f8>'), 'é', '<e9>')")
                             + " FROM upload_cells)",
    "csv_widths": "SELECT 'good' AS file, 25 AS header_fields, 25 AS widest UNION ALL SELECT 'narrow', 24, 24 "
                  "UNION ALL SELECT 'ragged', 25, CAST(max(length(line) - length(replace(line, ',', ''))) + 1 AS INT) "
                  f"FROM (SELECT {RAGGED} AS line FROM base WHERE {UPLOAD_ROWS[0]})",
    "csv_misplaced_columns": _MISPLACED,
    "written_summary": f"SELECT s.*, b.batch FROM ({_SUMMARY}) s, (VALUES ('batch1'), ('batch2')) b(batch)",
    "enrollment_from_csv": _TAILS["enrollment_check"],
}


def oracle_sql() -> dict[str, str]:
    out = {name: _common() + tail for name, tail in _TAILS.items()}
    for name in CROWDED:
        out[f"{name}_crowded"] = _common(crowded=True) + _TAILS[name]
    for name in ("unresolved_registry", "unresolved_upload"):
        out[name] = _common(crowded=True) + _TAILS[name]
    for name in ("key_cascade", "linked_pairs"):
        out[f"{name}_named_only"] = _common(named_only=True) + _TAILS[name]
    return out
