"""Chat formatting: turns to text segments, each with a flag that says whether it is learnt from.

A template declares what stands before and after a turn, which roles are learnt from, which
role may follow which, and which control strings texts must not contain. A finite-state machine
(its state is the role last seen) checks the order of turns. Control strings inside texts, and
the escape character, become the escape character and a letter; that is undone on reading.

Defined results: turns are ordered by turn, then role, then text; null turns come first. A null
text or role is empty. Rows with a null conv_id form one conversation. A conversation that breaks
the order is formatted all the same; `problem` names the first turn that breaks it. An empty
table gives no rows; other columns of the input are ignored. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written. `{role}` stands for the role."""
    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    learnt: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>",
                                 "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"
    # From a state (the role before, or the start) to the roles that may follow.
    follows: dict = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    @cached_property
    def _text(self) -> tuple:
        return self._codes(())

    @cached_property
    def _role(self) -> tuple:
        return self._codes(("\n",))

    def _codes(self, more: tuple[str, ...]) -> tuple:
        """What stands for each string that must not appear, how to find them, and back."""
        codes = {c: f"{self.escape}{chr(ord('a') + i)}" for i, c in enumerate((*self.controls, *more))}
        codes[self.escape] = self.escape * 2
        found = re.compile("|".join(re.escape(c) for c in sorted(codes, key=len, reverse=True)))
        coded = re.compile(re.escape(self.escape) + ".", re.S)
        return codes, found, {code: c for c, code in codes.items()}, coded

    def escaped(self, text: str, as_role: bool = False) -> str:
        codes, found, _, _ = self._role if as_role else self._text
        return found.sub(lambda m: codes[m[0]], text)

    def plain(self, text: str, as_role: bool = False) -> str:
        _, _, back, coded = self._role if as_role else self._text
        return coded.sub(lambda m: back[m[0]], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.before.format(role=self.escaped(role, True)), False),
                (self.escaped(text), role in self.learnt), (self.after, False)]

    def parsed(self, turn: str) -> tuple[str, str]:
        """Role and text of a written turn."""
        head, _, tail = self.before.partition("{role}")
        role, _, text = turn.removeprefix(head).partition(tail)
        return self.plain(role, True), self.plain(text.removesuffix(self.after))

    def step(self, state: str, role: str) -> str | None:
        """The next state; None if the role may not follow."""
        return role if role in self.follows.get(state, ()) else None


def _format(template: Template):
    def run(batches):
        conv, state, position, problem = object(), "start", 0, None
        for batch in batches:
            rows = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                role, text = role or "", text or ""
                if c != conv:
                    conv, state, position, problem = c, "start", 0, None
                following = template.step(state, role)
                if following is None and problem is None:
                    problem = f"turn {position}: {role or 'no role'} after {state}"
                state = role
                rows.append((c, position, [{"text": t, "loss": x} for t, x in template.segments(role, text)],
                             state in template.ends, problem))
                position += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field(0).type),
                 pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
                 pa.array([r[3] for r in rows], pa.bool_()), pa.array([r[4] for r in rows], pa.string())],
                ["conv_id", "position", "segments", "may_end", "problem"])

    return run


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, position, segments (text, loss), may_end, problem.

    A turn is a row, so a conversation of any length passes through a task as a stream.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ordered = conversations.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        _format(template), f"conv_id {kind}, position bigint, "
        "segments array<struct<text: string, loss: boolean>>, may_end boolean, problem string")


def _read(template: Template):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "problem"]

    def run(batches):
        conv, started, kind = None, False, pa.int64()
        turns, learnt, sizes, problem, ends = hashlib.sha256(), hashlib.sha256(), [0, 0, 0], None, False
        done = []

        def row():
            return (conv, sizes[0], turns.hexdigest(), sizes[1], learnt.hexdigest(), sizes[2],
                    problem or (None if ends else "the last turn may not be the last"))

        def out():
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, segments, may_end, wrong in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if started and c != conv:
                    done.append(row())
                    turns, learnt, sizes = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                conv, started, problem, ends = c, True, wrong, may_end
                role, text = template.parsed("".join(s["text"] for s in segments))
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = template.plain("".join(s["text"] for s in segments if s["loss"]))
                learnt.update(masked.encode("utf-8", "surrogatepass"))
                sizes = [sizes[0] + 1, sizes[1] + len(masked), sizes[2] + sum(len(s["text"]) for s in segments)]
            if done:
                yield out()
                done.clear()
        if started:
            done.append(row())
            yield out()

    return run


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, parsed back from its segments: digests and lengths of its turns and of
    what is learnt from, the length of the formatted text, and what is wrong with its order."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "segments", "may_end", "problem").mapInArrow(
        _read(template), f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, problem string")


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts look like control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(probe)
