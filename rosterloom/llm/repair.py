"""Conversation structure repair: the cheapest edits that make a conversation's turns well formed.

Well formed is an optional system turn and then pairs of user and assistant, or nothing at all. A
turn is kept (0), given another role (2) or deleted (3); turns without text can be inserted anywhere
(2). Blank turns and repeats of an earlier turn have to be deleted; a turn that breaks off costs 1
more unless it is deleted. Of several cheapest repairs the one is taken whose edits, spelt by their
initials, come first.

Only a small mark per turn (its kind and a row number) is sorted by conversation, never the texts: a
task goes through its conversations turn by turn, over the borders of batches, with four costs at a
time, one for each state the repaired turns can be in. It keeps how each state was reached, four
bytes a turn; of a giant conversation these go to a file in the shared work folder and are read from
its end. Costs alone do not decide between equal ones: the four ways are kept in the order of their
edits as well, which is all that a later comparison needs to know. Texts are joined by row number,
so those of one conversation are spread over all tasks.

Defined results: turns are ordered by turn, null first, then role, then a digest of role and text. A
null role or text is empty; rows without a conv_id are one conversation; roles are told apart by
their first letter. Repeated rows are turns of their own, the later ones repeats. An empty table
gives no rows. Other columns are ignored. A long text is moved as one cell, and is never with a mark.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.tables import kept_as, same, small_batches
from rosterloom.workspace import work_folder

WHITE = " \t\n\v\f\r"
STOPS = ".!?"
ROLES = "sua"  # initials; place + 1 is the number of a role, 0 any other
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
FAULTS = ("", "truncated", "blank", "duplicate")
LEGAL = {(1, 2), (2, 3), (3, 2)}

# What the repaired turns so far end in: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
TAILS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # insertions that end it well
RELABEL, DELETE, INSERT, CUT = 2, 3, 2, 1
FAR = 1 << 60
SPILL = 1 << 18  # turns of one conversation held in memory


def _ways(initial: int, fault: int) -> list[tuple[int, int, int, str, int]]:
    """All ways over one turn: (state before, state after, cost, edits, insertions).

    More than one insertion is of use after a system turn alone: elsewhere two of them lead
    back to where one already is.
    """
    out, more = [], CUT if fault == TRUNCATED else 0
    for state in range(4):
        at = state
        for n in range(3 if state == SYSTEM else 2):
            before, paid = "I" * n, INSERT * n
            out.append((state, at, paid + DELETE, f"{before}D", n))
            if fault in (SOUND, TRUNCATED):
                follows = SYSTEM if initial == 1 and at == START else initial if initial == NEXT[at] else None
                if follows is not None:
                    out.append((state, follows, paid + more, f"{before}K", n))
                out.append((state, NEXT[at], paid + RELABEL + more, f"{before}R", n))
            at = NEXT[at]
    return out


WAYS = {initial | fault << 2: _ways(initial, fault) for initial in range(4) for fault in range(4)}


class Trail:
    """How every state was reached, turn by turn; read back from the end."""

    def __init__(self, folder: str, most: int = SPILL):
        self.folder, self.most = folder, most
        self.rows, self.kinds, self.steps = array("q"), bytearray(), bytearray()
        self.sizes: list[int] = []
        self.path = self.file = None

    def add(self, row: int, kind: int, steps: list[int]) -> None:
        self.rows.append(row)
        self.kinds.append(kind)
        self.steps += bytes(steps)
        if len(self.rows) >= self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            store, folder = fs.FileSystem.from_uri(self.folder)
            if isinstance(store, fs.LocalFileSystem):
                store.create_dir(folder)
            self.path = store, f"{folder}/{uuid.uuid4().hex}"
            self.file = store.open_output_stream(self.path[1])
        self.file.write(self.rows.tobytes() + self.kinds + self.steps)
        self.sizes.append(len(self.rows))
        self.rows, self.kinds, self.steps = array("q"), bytearray(), bytearray()

    def backwards(self) -> Iterator[tuple[int, int, bytes]]:
        yield from self._turns(self.rows, self.kinds, self.steps)
        if self.file is None:
            return
        self.file.close()
        store, path = self.path
        with store.open_input_file(path) as file:
            end = file.size()
            for n in reversed(self.sizes):
                end -= 13 * n
                block = file.read_at(13 * n, end)
                rows = array("q")
                rows.frombytes(block[:8 * n])
                yield from self._turns(rows, block[8 * n:9 * n], block[9 * n:])
        store.delete_file(path)

    @staticmethod
    def _turns(rows, kinds, steps):
        for i in reversed(range(len(rows))):
            yield rows[i], kinds[i], steps[4 * i:4 * i + 4]


class Repair:
    """The search over one conversation."""

    def __init__(self, conv, folder: str, most: int = SPILL):
        self.conv, self.trail, self.before = conv, Trail(folder, most), None
        self.cost, self.rank, self.edits = [0, FAR, FAR, FAR], [0, 0, 0, 0], [0, 0, 0, 0]

    def add(self, row: int, kind: int) -> None:
        initial = kind & 3
        illegal = self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial
        best: list = [None] * 4
        cost, rank = self.cost, self.rank
        for i, (old, new, paid, edits, _) in enumerate(WAYS[kind]):
            if cost[old] < FAR:
                way = (cost[old] + paid, rank[old], edits, i)
                if best[new] is None or way < best[new]:
                    best[new] = way
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        self.rank = [0] * 4
        for place, (_, _, state) in enumerate(order):
            self.rank[state] = place
        self.edits = [self.edits[WAYS[kind][b[3]][0]] + len(b[2]) if b else 0 for b in best]
        self.cost = [b[0] if b else FAR for b in best]
        self.trail.add(row, kind | illegal << 4, [b[3] if b else 255 for b in best])

    def edits_backwards(self) -> Iterator[tuple]:
        """(position, row or -1, edit, role or None, fault, illegal), from the last edit to the first."""
        state = min((s for s in range(4) if self.cost[s] < FAR),
                    key=lambda s: (self.cost[s] + INSERT * TAILS[s], self.rank[s]))
        position = self.edits[state] + TAILS[state]

        def inserted(at: int, n: int):
            nonlocal position
            names = []
            for _ in range(n):
                at = NEXT[at]
                names.append(NAMES[at])
            for name in reversed(names):
                position -= 1
                yield position, -1, "I", name, SOUND, False

        yield from inserted(state, TAILS[state])
        for row, kind, steps in self.trail.backwards():
            old, new, _, edits, n = WAYS[kind & 15][steps[state]]
            position -= 1
            yield (position, row, edits[-1], NAMES[new] if edits[-1] == "R" else None, kind >> 2 & 3, bool(kind >> 4))
            yield from inserted(old, n)
            state = old


PLAN = "conv string, position bigint, row bigint, edit string, new_role string, fault int, illegal boolean"


def _plan(folder: str, most: int):
    columns = [c.split()[0] for c in PLAN.split(", ")]

    def run(frames):
        current, done = None, []

        def frame():
            out = pd.DataFrame(done, columns=columns)
            done.clear()
            return out

        def finished():
            for edit in current.edits_backwards():
                done.append((current.conv, *edit))
                if len(done) >= 20_000:
                    yield frame()

        for part in frames:
            for conv, row, kind in zip(part["conv"].tolist(), part["row"].tolist(), part["kind"].tolist()):
                if current is None or conv != current.conv:
                    if current is not None:
                        yield from finished()
                    current = Repair(conv, folder, most)
                current.add(row, kind)
        if current is not None:
            yield from finished()
        if done:
            yield frame()

    return run


def repair(conversations: DataFrame, most: int = SPILL) -> DataFrame:
    """Every edit of every conversation: conv_id, position (from 0), edit (K, R, D or I), fault, illegal (whether
    its role may not follow that of the turn before), turn, role and text after the edit. Rows of edit D are
    what was taken out, as it was; all others, in order of position, are the repaired conversation."""
    spark = conversations.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "repair")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = kept_as(conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row")), f"{folder}/rows")
    bare = F.rtrim("text", F.lit(WHITE))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
    marks = rows.select(
        F.col("conv_id").cast("string").alias("conv"), "turn", "role", digest.alias("digest"), "row",
        F.when(F.col("role") == "", 0).otherwise(initial).alias("initial"),
        F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(*STOPS), TRUNCATED).otherwise(SOUND).alias("fault"))
    order = [F.asc_nulls_first("turn"), "role", "digest", "row"]
    seen = F.row_number().over(Window.partitionBy("conv", "digest").orderBy(*order)) > 1
    fault = F.when(seen & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    marked = (marks.withColumn("kind", (F.col("initial") + 4 * fault).cast("int"))
              .repartition("conv").sortWithinPartitions("conv", *order).select("conv", "row", "kind"))
    plan = kept_as(marked.mapInPandas(_plan(f"{folder}/trails", most), PLAN), f"{folder}/plan")
    # Inserted turns have no text to fetch, so they stay out of the join, where they would all have one key.
    nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.select("turn", "role", "text").dtypes]
    fetched = plan.filter("row >= 0").join(rows.select("row", "turn", "role", "text"), "row")
    edits = fetched.unionByName(plan.filter("row < 0").select("*", *nothing))
    return edits.select(
        F.col("conv").cast(kind).alias("conv_id"), "position", "edit",
        F.element_at(F.array(*map(F.lit, FAULTS)), F.col("fault") + 1).alias("fault"), "illegal", "turn",
        F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


REPORT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
_COSTS = {"K": 0, "R": RELABEL, "D": DELETE, "I": INSERT}


class Report:
    """What one conversation's edits come to, taken in one after another."""

    def __init__(self):
        self.turns, self.first, self.last, self.n_illegal, self.cost = 0, None, None, 0, 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.audit, self.sha, self.empty = [], hashlib.sha256(), True

    def add(self, edit, fault, illegal, turn, role, text) -> None:
        self.audit.append(edit)
        self.faults[fault] += 1
        self.n_illegal += illegal
        self.cost += _COSTS[edit] + (CUT if fault == "truncated" and edit != "D" else 0)
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if edit != "D":
            self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.n_illegal,
                self.cost, "".join(self.audit), self.sha.hexdigest())


def _report(batches):
    conv, current, done, kind = None, None, [], pa.int64()
    names = ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [kind, *types])], names)
        done.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field(0).type
        for c, *edit in zip(*(column.to_pylist() for column in batch.columns)):
            if current is None or c != conv:
                if current is not None:
                    done.append((conv, *current.row()))
                conv, current = c, Report()
            current.add(*edit)
        if done:
            yield out()
    if current is not None:
        done.append((conv, *current.row()))
        yield out()


def reports(repaired: DataFrame) -> DataFrame:
    """Per conversation: gaps in its numbers of turns, faults, cost, the edits' initials, and the SHA-256 of the
    repaired turns. Only the digest needs a conversation in sequence; it is taken as a stream."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    ordered = repaired.select("conv_id", "edit", "fault", "illegal", "turn", "role", "text", "position")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "position").drop("position")
    return ordered.mapInArrow(_report, f"conv_id {kind}, {REPORT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults by crc32 of conv_id and turn: one row in 20 each is dropped, emptied, robbed of
    its stops, repeated, or made a user's."""
    spelt = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.pmod(F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1])), F.lit(20))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, STOPS, "")).otherwise(text)
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"),
        copies.alias("copy")).drop("copy")


def repaired_reports(conversations: DataFrame) -> DataFrame:
    """The report of every conversation after the damage; conversations of which nothing is left have an empty one."""
    found = reports(repair(damaged(conversations))).withColumnRenamed("conv_id", "found")
    nothing = dict(zip((c.split()[0] for c in REPORT.split(", ")), Report().row()))
    all_ids = conversations.select("conv_id").distinct()
    joined = all_ids.join(found, same(F.col("conv_id"), F.col("found")), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in nothing.items()])
