"""Folders of CSV files with one fixed set of columns, named by position, all text.

Files are read in splits, with line breaks in cells, and parsed once: the cells are stored with the number
of fields of their record, from which the widths are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rosterloom.config import ROSTER_COLUMNS
from rosterloom.functions.text import cell_text, decoded
from rosterloom.sources.csv_records import joined, open_splits, records
from rosterloom.workspace import work_folder

_BAD = "_unparsed"


class ColumnCountMismatch(ValueError):
    """A file does not have the expected number of columns."""


class EmptyInput(ValueError):
    """There is no file to read."""


def _text_schema(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def _field_count(record: Column) -> Column:
    """Fields of a raw CSV record: separators outside quotes, plus one."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


# Encodings whose bytes do not agree with ASCII on quotes, commas and line ends.
_WIDE = ("UTF-16", "UTF-32", "UCS-2", "UTF16", "UTF32")


def _parsed(rows: DataFrame, columns: tuple[str, ...], encoding: str, bad_bytes: str) -> DataFrame:
    """Records as cells, with the number of fields of each. Blank records are left out."""
    text = F.rtrim(decoded(F.col("record"), encoding, bad_bytes), F.lit("\r"))
    schema = _text_schema(columns).add(_BAD, StringType())
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    cells = rows.withColumn("_text", text).filter(F.btrim("_text") != "").withColumn(
        "_cells", F.from_csv("_text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    fields = F.when(F.col(f"_cells.{_BAD}").isNull(), len(columns)).otherwise(_field_count(F.col("_text")))
    return cells.select(F.col("file").alias("_file"), F.col("header").alias("_header"), fields.alias("_fields"),
                        *[F.col(f"_cells.{c}").alias(c) for c in columns])


def parsed_folder(spark: SparkSession, folder: str, columns: tuple[str, ...] = ROSTER_COLUMNS, multiline: bool = True,
                  encoding: str = "UTF-8", bad_bytes: str = "replace") -> DataFrame:
    """All records of a folder, headers included, parsed and stored: the columns, and _file (a hash of its path), _header
    and _fields (how many fields the record has).

    Records end with a line feed, or a carriage return and one. Any number of tasks read a file; the records that
    go over the border of two splits are put together afterwards.
    """
    if encoding.upper().startswith(_WIDE):
        raise ValueError(f"{encoding} does not agree with ASCII; convert the files first")
    out = work_folder(spark, "parsed")
    ends = open_splits(spark, folder) if multiline else {}
    found = records(spark, folder, ends, multiline)
    rows = found.filter("opened IS NULL").select("file", "header", "record")
    if ends:
        # Pieces are few, two for a split at most.
        pieces = found.filter("opened IS NOT NULL")
        rows = rows.unionAll(joined(pieces).select("file", "header", "record"))
    cells = _parsed(rows, columns, encoding, bad_bytes)
    cells.write.parquet(f"{out}/cells")
    return spark.read.schema(cells.schema).parquet(f"{out}/cells")


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder and the hashes of their paths; no content is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    path = F.col("_metadata.file_path")
    return listed.select(path.alias("file"), F.xxhash64(path).alias("_file"))


def widths(parsed: DataFrame, folder: str) -> DataFrame:
    """Per file: the fields of its header and of its widest record, of what `parsed_folder` stored."""
    counts = parsed.groupBy("_file").agg(
        F.max(F.when(F.col("_header"), F.col("_fields"))).alias("header_fields"), F.max("_fields").alias("widest"))
    return counts.join(file_names(parsed.sparkSession, folder), "_file").select("file", "header_fields", "widest")


def file_widths(spark: SparkSession, folder: str, columns: tuple[str, ...] = ROSTER_COLUMNS,
                multiline: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Per file: the fields of its header and of its widest record."""
    return widths(parsed_folder(spark, folder, columns, multiline, encoding), folder)


def check_widths(parsed: DataFrame, folder: str, columns: tuple[str, ...] = ROSTER_COLUMNS) -> None:
    """Stop if a header has the wrong number of columns, or a record has too many fields.

    Names the files only: the records are personal data. Short records are fine; their
    missing fields are blank.
    """
    found = widths(parsed, folder)
    wrong = found.filter((F.col("header_fields") != len(columns)) | (F.col("widest") > len(columns)))
    shown = [row.file for row in wrong.select("file").orderBy("file").collect()]
    if shown:
        raise ColumnCountMismatch(f"Column count mismatch in file: {', '.join(shown)}")


def check_files(spark: SparkSession, folder: str) -> None:
    """Stop if the folder has no `.csv` file of any bytes. Reads names only; Spark does not show
    files of no bytes among others."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    if files.isEmpty():
        raise EmptyInput(f"No .csv file with content in folder: {folder}")


def checked_folder(spark: SparkSession, folder: str, columns: tuple[str, ...] = ROSTER_COLUMNS, *, multiline: bool = True,
                   encoding: str = "UTF-8", bad_bytes: str = "replace", check: bool = True) -> DataFrame:
    """`parsed_folder` of files that are there and have the right width."""
    check_files(spark, folder)
    parsed = parsed_folder(spark, folder, columns, multiline, encoding, bad_bytes)
    if check:
        check_widths(parsed, folder, columns)
    return parsed


def roster_cells(parsed: DataFrame, blank_as_null: tuple[str, ...] = (), missing_text: str = "NA") -> DataFrame:
    """The rows of parsed files, without headers, with the meaning of their cells."""
    return parsed.filter(~F.col("_header")).select(*[
        cell_text(F.col(c), missing_text, c in blank_as_null).alias(c) for c in parsed.columns if not c.startswith("_")])


def read_roster_folder(spark: SparkSession, folder: str, columns: tuple[str, ...] = ROSTER_COLUMNS,
                       *, blank_as_null: tuple[str, ...] = (), missing_text: str = "NA", **reading) -> DataFrame:
    """All `*.csv` files directly in a folder as one roster of text columns.

    Text stays as it is, leading zeros included. `NA` is null; a blank cell is '' or, for
    the columns in `blank_as_null`, null. `reading`: encoding; bad_bytes, which makes bytes that are not of the
    encoding U+FFFD or, if "spell", `<xx>`; multiline, without which a line is a record, which spares a pass over the
    lines with quotes; check, of the widths.
    """
    return roster_cells(checked_folder(spark, folder, columns, **reading), blank_as_null, missing_text)
