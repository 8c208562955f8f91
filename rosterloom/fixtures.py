"""Example rosters derived from the orders and customer tables.

One order is one student, one nation is one district. The recipes are SQL expressions that
mean the same in Spark and in DuckDB, so a check in another engine starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterloom.config import ROSTER_COLUMNS

BASE = {
    "k": "o_orderkey",
    "nk": "c_nationkey",
    "ck": "c_custkey",
    "aun": "lpad(CAST(100000000 + c_nationkey*1013 AS STRING),9,'0')",
    "sid": "lpad(CAST(o_orderkey AS STRING),10,'0')",
    "fn": "split_part('Ana,Ben,Cleo,Dev,Eli,Fay,Gus,Hana',',',CAST(o_orderkey % 8 AS INT)+1)",
    "ln": "split_part('Ash,Bell,Cole,Dunn,Ellis,Ford,Gray,Hale,Ives,Judd',',',"
          "CAST(floor(o_orderkey/8) % 10 AS INT)+1)",
    "dob": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "st": "split_part('Oak,Maple,Broad,Cedar,Walnut,Chestnut,Highland',',',"
          "CAST(o_orderkey % 7 AS INT)+1)",
    "sfx": "split_part('Street,Avenue,Drive,Road,Lane,Court,Place,Boulevard',',',"
           "CAST(floor(o_orderkey/7) % 8 AS INT)+1)",
    "abb": "split_part('St.,Ave.,Dr.,Rd.,Ln.,Ct.,Pl.,Blvd.',',',"
           "CAST(floor(o_orderkey/7) % 8 AS INT)+1)",
    "num": "CAST(o_orderkey % 97 + 1 AS STRING)",
}

REGISTRY = {
    "primero_sfa_name": "concat('Authority ', CAST(nk % 10 AS STRING))",
    "primero_aun9_3": "aun",
    "primero_school_code4": "CASE WHEN k%47=0 THEN NULL ELSE lpad(CAST(k%300 AS STRING),4,'0') END",
    "primero_pasecureid": "CASE WHEN k%41=0 THEN '' ELSE sid END",
    "primero_student_first_name": "CASE WHEN k%43=0 THEN NULL ELSE lower(fn) END",
    "primero_student_last_name": "lower(ln)",
    "primero_student_dob": "dob",
    "primero_student_address1": "concat(num,' ',st,' ',sfx)",
    "primero_eligibility": "CASE WHEN nk=22 THEN 'Other' ELSE "
                           "split_part('Free,Reduced,Paid,Denied',',',CAST(k%4 AS INT)+1) END",
    "primero_case_number": "concat('case',CAST(k%1000 AS STRING))",
    "primero_parent_first_name": "lower(concat('P',CAST(ck%50 AS STRING)))",
    "primero_parent_last_name": "lower(ln)",
}

UPLOAD = {
    "sebt_sfa_name": "concat('Authority ', CAST(nk % 10 AS STRING))",
    "sebt_aun9_3": "CASE WHEN k%5=0 THEN concat(' ',aun,' ') ELSE aun END",
    "sebt_school_code4": "CASE WHEN k%12=0 THEN CAST(k%300 AS STRING) "
                         "ELSE lpad(CAST(k%300 AS STRING),4,'0') END",
    "sebt_pasecureid": "CASE WHEN k%23=0 THEN '' WHEN k%17=0 THEN CAST(k AS STRING) "
                       "WHEN k%11=0 THEN concat('9',substring(sid,2,9)) ELSE sid END",
    "sebt_student_first_name": "CASE WHEN k%43=0 THEN NULL "
                               "WHEN k%5=0 THEN concat(' ',upper(fn),' ') ELSE fn END",
    "sebt_student_last_name": "upper(ln)",
    "sebt_student_dob": "dob",
    "sebt_student_address1": "CASE WHEN k%37=0 THEN '' WHEN k%53=0 THEN NULL "
                             "WHEN k%19=1 THEN concat(num,' Elm ',sfx) "
                             "WHEN k%3=0 THEN concat(num,' ',upper(st),' ',abb) "
                             "ELSE concat(num,' ',st,' ',sfx) END",
    "sebt_eligibility": "CASE WHEN nk=21 THEN 'OTHER' WHEN k%10=0 THEN 'FREE' ELSE "
                        "split_part('Free,Reduced,Paid,Denied',',',CAST(k%4 AS INT)+1) END",
    "sebt_case_number": "CASE WHEN k%59=0 THEN NULL "
                        "WHEN k%9=0 THEN concat('CASE',CAST(k%1000 AS STRING)) "
                        "ELSE concat('case',CAST(k%1000 AS STRING)) END",
    "sebt_parent_first_name": "CASE WHEN k%14=0 THEN '' ELSE concat('P',CAST(ck%50 AS STRING),' ') END",
    "sebt_parent_last_name": "ln",
}

# Crowded variants. On both sides one order in 50 shares a placeholder ID in one district;
# another one in 50 of the uploads has no name, no birth date and an unknown ID.
PLACEHOLDER = {"aun9_3": "100000000", "pasecureid": "0000000000"}
CROWDED_REGISTRY = REGISTRY | {
    f"primero_{c}": f"CASE WHEN k%50=7 THEN '{v}' ELSE {REGISTRY[f'primero_{c}']} END"
    for c, v in PLACEHOLDER.items()}
CROWDED_UPLOAD = UPLOAD | {
    "sebt_aun9_3": f"CASE WHEN k%50=7 THEN '{PLACEHOLDER['aun9_3']}' WHEN k%50=8 THEN '100001013' "
                   f"ELSE {UPLOAD['sebt_aun9_3']} END",
    "sebt_pasecureid": f"CASE WHEN k%50=7 THEN '{PLACEHOLDER['pasecureid']}' "
                       f"WHEN k%50=8 THEN concat('x', sid) ELSE {UPLOAD['sebt_pasecureid']} END",
    **{f"sebt_{c}": f"CASE WHEN k%50=8 THEN NULL ELSE {UPLOAD[f'sebt_{c}']} END"
       for c in ("student_first_name", "student_last_name", "student_dob")},
}

REGISTRY_ROWS = ("k%13<>0 AND nk<>23", "k%31=0")  # which rows; which of them twice
UPLOAD_ROWS = ("k%19<>0 AND nk<>24", "k%29=0")

# Uploads as they come, for the enrolment check: some district numbers carry a dash.
RAW_UPLOAD = {
    "aun9_3": "CASE WHEN k%4=0 THEN concat(substring(aun,1,3),'-',substring(aun,4,6)) "
              "WHEN k%101=0 THEN NULL ELSE aun END",
    "sfa_name": "concat('Authority ', CAST(nk % 10 AS STRING))",
    "pasecureid": "sid",
    "county": "concat('County ', CAST(nk % 6 AS STRING))",
}

# Uploads as files hold them, all 25 columns: separators, quotes and line breaks in cells, leading
# zeros, letters outside ASCII, the missing marker, blanks.
FILE_UPLOAD = {c: "CAST(NULL AS STRING)" for c in ROSTER_COLUMNS} | {
    c.removeprefix("sebt_"): recipe for c, recipe in UPLOAD.items()} | {
    "school_name": "concat('School \"', CAST(k%5 AS STRING), '\", ', st)",
    "student_middle_name": "CASE WHEN k%4=0 THEN 'NA' ELSE 'Lee' END",
    "student_address2": "CASE WHEN k%9=0 THEN concat('Floor 2', chr(10), 'rear') ELSE '' END",
    "student_apt_no": "lpad(CAST(k%30 AS STRING),3,'0')",
    "student_city": "CASE WHEN k%6=0 THEN 'Ærø' ELSE 'Saint-Rémy' END",
}

# Records of several widths as lines: two cells, blanks, and up to three cells too many.
RAGGED_HEADER = ",".join(f"column {i}" for i in range(25))
RAGGED = "concat(CAST(k AS STRING), ',', st, repeat(',', 23), repeat(',x', CAST(k%4 AS INT)))"

# The official table: one row per district but one, totals counted from all customers.
OFFICIAL = {
    "AUN": "lpad(CAST(100000000 + c_nationkey*1013 AS STRING),9,'0')",
    "County": "concat('County ', CAST(c_nationkey % 6 AS STRING))",
    "Total": "count(*)",
}


def _aliased(recipe: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in recipe.items()]


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table stored in fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = _spread(orders, "o_orderkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.selectExpr(*_aliased(BASE))


def _roster(rows: DataFrame, which: tuple[str, str], recipe: dict[str, str]) -> DataFrame:
    wanted, twice = which
    copies = f"explode(sequence(1, CASE WHEN {twice} THEN 2 ELSE 1 END)) AS copy"
    return rows.filter(wanted).selectExpr("*", copies).selectExpr(*_aliased(recipe))


def registry_roster(spark: SparkSession, sf_dir: str, recipe: dict[str, str] = REGISTRY) -> DataFrame:
    return _roster(base(spark, sf_dir), REGISTRY_ROWS, recipe)


def upload_roster(spark: SparkSession, sf_dir: str, recipe: dict[str, str] = UPLOAD) -> DataFrame:
    return _roster(base(spark, sf_dir), UPLOAD_ROWS, recipe)


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roster(base(spark, sf_dir), UPLOAD_ROWS, RAW_UPLOAD)


def file_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roster(base(spark, sf_dir), UPLOAD_ROWS, FILE_UPLOAD)


def ragged_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roster(base(spark, sf_dir), UPLOAD_ROWS, {f"`{RAGGED_HEADER}`": RAGGED})


def official_enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    counted = customer.filter("c_nationkey <> 20").groupBy("c_nationkey").count()
    return counted.selectExpr(*_aliased(OFFICIAL | {"Total": "count"}))


def roster_ctes(crowded: bool = False) -> str:
    """The same rosters as common table expressions (without the WITH)."""
    registry, upload = (CROWDED_REGISTRY, CROWDED_UPLOAD) if crowded else (REGISTRY, UPLOAD)

    def table(recipe, which):
        wanted, twice = which
        columns = ", ".join(_aliased(recipe))
        return (f"SELECT {columns} FROM base WHERE {wanted} "
                f"UNION ALL SELECT {columns} FROM base WHERE {wanted} AND {twice}")

    official = ", ".join(_aliased(OFFICIAL))
    return f"""
base AS (SELECT {", ".join(_aliased(BASE))} FROM orders JOIN customer ON o_custkey = c_custkey),
registry_raw AS ({table(registry, REGISTRY_ROWS)}),
upload_raw AS ({table(upload, UPLOAD_ROWS)}),
upload_file AS ({table(RAW_UPLOAD, UPLOAD_ROWS)}),
upload_cells AS ({table(FILE_UPLOAD, UPLOAD_ROWS)}),
official AS (SELECT {official} FROM customer WHERE c_nationkey <> 20 GROUP BY c_nationkey)"""
