"""Records of CSV files whose cells may hold line breaks, read in parallel within a file.

A file is read as lines, in splits. Whether a line begins within quotes depends on all lines before it,
but only through one bit; so a split is a function from that bit to that bit. One pass over the lines that
have a quote works these functions out, the driver chains them (one row per split with quotes), and in the
second pass every split knows how it begins. What it can complete are records; the open record at its
end, and the end of an open one at its beginning, are fragments, which are put together after the parse.

A quote opens a quoted cell only where a cell begins; within it a doubled quote is a quote. Bytes are looked
at before they are decoded, so the encoding must agree with ASCII on quotes, commas and line ends.
"""

from __future__ import annotations

import sys
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_within(line: bytes, within: bool) -> bool:
    """Whether the end of a line is within quotes, given whether its beginning is."""
    at, n = 0, len(line)
    while True:
        if within:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
            at = line.find(b",", at)  # what follows a closing quote belongs to the cell
            if at < 0:
                return False
            at, within = at + 1, False
        elif at < n and line[at:at + 1] == b'"':
            at, within = at + 1, True
        else:
            at = line.find(b',"', at)
            if at < 0:
                return False
            at += 1


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    text = spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(folder)
    return text.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch):
    """The slices of a batch that belong to one split each."""
    if not batch.num_rows:
        return
    places = np.stack([batch.column(c).to_numpy() for c in ("file", "start")], axis=1)
    cuts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1)])
    for a, b in zip(cuts, [*cuts[1:], len(places)]):
        yield tuple(int(x) for x in places[a]), batch.slice(a, b - a)


def _functions(batches):
    """Per split with quotes: how it ends if it begins outside, or within, and whether the latter is ever closed."""
    known: dict[tuple[int, int], list[bool]] = {}
    for batch in batches:
        for place, part in _runs(batch):
            out = known.setdefault(place, [False, True, False])
            for line in part.column("line").to_pylist():
                same = out[0] == out[1]
                out[0] = ends_within(line, out[0])
                out[1] = out[0] if same else ends_within(line, out[1])
                out[2] |= not out[1]
    rows = [(*place, *out) for place, out in known.items()]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                     ["file", "start", "outside", "within", "closes"])


def chained(splits: list[tuple[int, bool, bool, bool]]) -> list[tuple[int, int | None]]:
    """Of one file's splits with quotes, in order: (start, where the record began that is open at the end, if any)."""
    out, opened = [], None
    for start, outside, within, closes in splits:
        if opened is None:
            opened = start if outside else None
        elif closes:
            opened = start if within else None
        out.append((start, opened))
    return out


def open_splits(spark: SparkSession, folder: str) -> dict[int, list[tuple[int, int | None]]]:
    """By file, where splits end within quotes. Files without any are left out; an entry is a split, not a row."""
    found = _lines(spark, folder).filter(F.contains("line", F.lit(b'"'))).mapInArrow(
        _functions, "file bigint, start bigint, outside boolean, within boolean, closes boolean")
    by_file: dict[int, list] = {}
    for row in found.collect():
        by_file.setdefault(row.file, []).append(tuple(row)[1:])
    ends = {file: chained(sorted(splits)) for file, splits in by_file.items()}
    return {file: splits for file, splits in ends.items() if any(opened is not None for _, opened in splits)}


def _records(ends, breaks: bool):
    names = ["file", "start", "header", "opened", "record"]

    def run(batches):
        place, held, within, opened, header = None, [], False, None, False

        def rows(records: pa.Array, head: bool):
            """`head`: the first of them is the end of a record that another split began."""
            nonlocal header
            n = len(records)
            is_header = np.zeros(n, bool)
            for i in range(n if header else 0):
                if i or not head:
                    if records[i].as_py().strip():
                        is_header[i], header = True, False
                        break
            first = [opened] if head and n else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, place[0])), pa.array(np.full(n, place[1])), pa.array(is_header),
                 pa.array(first + [None] * (n - len(first)), pa.int64()), records], names)

        def rest():
            """What is open at the end of a split is a fragment. The last line of a file may be it, quotes unclosed."""
            if held:
                piece = pa.array([b"\n".join(x.as_py() for part in held for x in part)], pa.binary())
                began = opened if entered else place[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[0]]), pa.array([place[1]]), pa.array([header and not entered]),
                     pa.array([began], pa.int64()), piece], names)

        entered = False  # whether what is held began in another split
        for batch in batches:
            for here, part in _runs(batch):
                if here != place:
                    if place is not None:
                        yield from rest()
                    place, held, header = here, [], here[1] == 0
                    before = ends.value.get(here[0], [])
                    k = bisect_left(before, here[1], key=lambda e: e[0]) - 1
                    opened = before[k][1] if k >= 0 else None
                    within = entered = opened is not None
                lines = part.column("line")
                after = np.zeros(len(lines), bool)
                if breaks:
                    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
                    last = 0
                    for i in quoted:
                        after[last:i] = within
                        within = ends_within(lines[int(i)].as_py(), within)
                        after[i], last = within, i + 1
                    after[last:] = within
                done = np.flatnonzero(~after)
                if not len(done):
                    held.append(lines)
                    continue
                n_held = sum(len(x) for x in held)
                if n_held or after[:done[-1] + 1].any():
                    everything = pa.concat_arrays([*held, lines.slice(0, int(done[-1]) + 1)])
                    offsets = pa.array(np.r_[0, done + 1 + n_held], pa.int32())
                    records = pc.binary_join(pa.ListArray.from_arrays(offsets, everything), b"\n")
                else:
                    records = lines.slice(0, int(done[-1]) + 1)
                yield from rows(records, entered)
                held, entered = [], False
                if done[-1] + 1 < len(lines):
                    held.append(lines.slice(int(done[-1]) + 1))
        if place is not None:
            yield from rest()

    return run


RECORDS = "file bigint, start bigint, header boolean, opened bigint, record binary"


def records(spark: SparkSession, folder: str, ends: dict, breaks: bool = True) -> DataFrame:
    """The records of all `*.csv` files directly in a folder, as bytes, without their line ends: file (a hash of its path),
    start of the split, header (the first record of a file that is not blank), opened and record.

    `opened` is null for whole records. Rows that have it are pieces, in order of start, of the record that the split at that
    place began. `ends` is from `open_splits`; if it is empty there are none. Without `breaks` every line is a record.
    """
    return _lines(spark, folder).mapInArrow(_records(spark.sparkContext.broadcast(ends), breaks), RECORDS)


def joined(pieces: DataFrame) -> DataFrame:
    """Whole records from their pieces. There is one record for a split at most."""
    parts = F.sort_array(F.collect_list(F.struct("start", "header", "record")))
    text = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(
        whole, F.when(F.length(whole) > 0, F.lit(b"\n")).otherwise(F.lit(b"")), p["record"]))
    return pieces.groupBy("file", "opened").agg(parts.alias("parts")).select(
        "file", F.col("opened").alias("start"), F.col("parts")[0]["header"].alias("header"), text.alias("record"))


# The code of this module goes along with its functions: executors do not need the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
