"""Column → Column text functions. All stay inside the JVM, but for decoding of other than UTF-8 and Latin-1."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when trimming.
WHITESPACE = " \t\r\n"

# Whole words of an address and their short forms, in order of use.
ADDRESS_WORDS = (
    ("street", "st"),
    ("avenue", "ave"),
    ("drive", "dr"),
    ("road", "rd"),
    ("lane", "ln"),
    ("court", "ct"),
    ("place", "pl"),
    ("boulevard", "blvd"),
)


def tidy(c: Column) -> Column:
    """Trim white space at both ends and lower-case."""
    return F.lower(F.btrim(c, F.lit(WHITESPACE)))


def tidy_key(c: Column) -> Column:
    """`tidy` for key columns: cast to text and repair bad bytes first."""
    return tidy(F.make_valid_utf8(c.cast("string")))


def decoded(c: Column, encoding: str = "UTF-8", bad_bytes: str = "replace") -> Column:
    """Bytes as text. A byte that is not of the encoding becomes U+FFFD or, with `spell`, its number: `<e9>`."""
    if bad_bytes not in ("replace", "spell"):
        raise ValueError("bad_bytes is 'replace' or 'spell'")
    if encoding.upper() in ("ISO-8859-1", "LATIN1", "LATIN-1"):
        return F.decode(c, "ISO-8859-1")
    text = c.cast("string")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        return decode_udf(encoding, bad_bytes)(c)
    if bad_bytes == "replace":
        return F.make_valid_utf8(text)
    # The UDF sees nulls where there is nothing to spell.
    valid = F.is_valid_utf8(text)
    return F.when(valid, text).otherwise(decode_udf(encoding, bad_bytes)(F.when(~valid, c)))


def decode_udf(encoding: str, bad_bytes: str):
    """Decoding by Python's codecs, a batch at a time."""

    def spelt(error: UnicodeDecodeError) -> tuple[str, int]:
        return "".join(f"<{b:02x}>" for b in error.object[error.start:error.end]), error.end

    @F.pandas_udf("string")
    def decode(cells: pd.Series) -> pd.Series:
        codecs.register_error("rosterloom-spell", spelt)
        errors = "replace" if bad_bytes == "replace" else "rosterloom-spell"
        return cells.map(lambda b: None if b is None else bytes(b).decode(encoding, errors))

    return decode


def cell_text(c: Column, missing_text: str = "NA", blank_as_null: bool = False) -> Column:
    """Meaning of a CSV cell: the missing marker is null; a blank is '' or, on request, null."""
    if blank_as_null:
        return F.nullif(F.nullif(c, F.lit(missing_text)), F.lit(""))
    return F.when(c == missing_text, F.lit(None)).otherwise(F.coalesce(c, F.lit("")))


def text_key(parts: list[Column], separator: str = "_", missing_text: str = "NA",
             keep_missing: bool = True) -> Column:
    """Join key as text. A missing part is spelt out, or makes the whole key null."""
    spelt = [F.coalesce(p, F.lit(missing_text)) for p in parts] if keep_missing else parts
    woven = [spelt[0]]
    for part in spelt[1:]:
        woven += [F.lit(separator), part]
    return F.concat(*woven)


def _one_pass(words: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    """One pattern for all words, with groups around the letters the short forms keep.

    'road' → 'rd' becomes (r)oa(d), and all groups, most of them empty, the replacement.
    A short form is made of letters of its word in order, and no replacement makes a new
    word, so one pass does what one pass per word would do.
    """
    shapes = []
    for word, short in words:
        rest = list(short)
        shape = "".join(f"({rest.pop(0)})" if rest and letter == rest[0] else letter for letter in word)
        if rest:
            raise ValueError(f"{short!r} is not made of letters of {word!r}")
        shapes.append(shape)
    groups = sum(len(short) for _, short in words)
    # (?U): word boundaries by Unicode letters, whatever the Java version.
    return rf"(?U)\b(?:{'|'.join(shapes)})\b", "".join(f"${g}" for g in range(1, groups + 1))


_ADDRESS_PATTERN, _ADDRESS_REPLACEMENT = _one_pass(ADDRESS_WORDS)


def standardize_address(c: Column) -> Column:
    """Lower-case, trim, shorten the street words, drop the dots. Inner spaces stay."""
    short = F.regexp_replace(tidy(c), _ADDRESS_PATTERN, _ADDRESS_REPLACEMENT)
    return F.replace(short, F.lit("."), F.lit(""))


def is_filled(c: Column) -> Column:
    """Neither null nor blank; never null itself."""
    return c.isNotNull() & (c != "")


def id_length_flag(c: Column, length: int = 10) -> Column:
    """Null for no ID, 'TRUE' for an ID of the expected length, else its length as text."""
    n = F.length(c)
    return F.when(c.isNull(), F.lit(None)).when(n == length, F.lit("TRUE")).otherwise(n.cast("string"))
