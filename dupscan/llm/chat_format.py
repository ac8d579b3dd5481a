"""Chat formatting: a finite-state machine over roles, and a declarative template that emits segments with loss flags.

A template gives each role an opening and a closing mark and says whether the role's text counts for the loss.  A turn
becomes up to three segments: opening, text (escaped), closing; only texts of roles that learn have loss = true.  The
escape character is put before itself and before each character that can begin a mark, so no text can contain a mark and
reading back is exact.

The machine has the states start, system, user, assistant, tool and checks each turn against `MOVES`; the first turn that
has no move makes the conversation invalid from there on.  Nothing is dropped: `valid` says how far the order held.

Rows are dealt by conversation and sorted by turn; a task streams them and keeps only the state of the conversation it is
in, so a conversation of any length needs bounded memory.

Nulls and ties: a null text or role is empty; turns sort nulls first, equal turns by role and text; repeated rows are
turns of their own; a null conversation id is a conversation of its own; other columns are ignored.  Tests: tests/llm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.llm.shared import batch

#: Which role may follow which; the key is the state, that is the last role.
MOVES = {
    "start": {"system", "user"},
    "system": {"user"},
    "user": {"assistant"},
    "assistant": {"user", "tool"},
    "tool": {"assistant", "tool"},
}


@dataclass(frozen=True)
class Template:
    """Marks around a turn.  `{role}` in `opening` stands for the role, escaped; each mark begins with a character of
    `guarded`, and so does what ends a role inside an opening."""

    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    learns: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))
    escape: str = "\\"
    guarded: str = "<|[]"

    def quote(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.escape + self.guarded)}])", lambda m: self.escape + m[1], text)

    def unquote(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        head = self.opening.replace("{role}", self.quote(role))
        return [(head, False), (self.quote(text), role in self.learns), (self.closing, False)]

    def read(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of formatted text."""
        before, after = self.opening.split("{role}")
        body = rf"((?:[^{re.escape(self.escape + self.guarded)}]|{re.escape(self.escape)}.)*)"
        turn = re.compile(re.escape(before) + body + re.escape(after) + body + re.escape(self.closing), re.S)
        out, at = [], 0
        while at < len(text):
            m = turn.match(text, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            out.append((self.unquote(m[1]), self.unquote(m[2])))
            at = m.end()
        return out


def next_state(state: str, role: str) -> str | None:
    return role if role in MOVES.get(state, ()) else None


SEGMENTS = "conv_id long, part long, turn long, role string, valid boolean, segments array<struct<text:string,loss:boolean>>"


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Formatted turns: conv_id, part (0, 1, ... in a conversation), turn, role, valid, segments; the formatted text of a
    conversation is its segments, one after another.  Partitions hold whole conversations in order."""
    piece = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("valid", pa.bool_()), ("segments", piece)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, state = (), 0, "start"
        for rb in it:
            for at in range(0, len(rb), 512):
                out = []
                for key, turn, role, text in zip(*(c.to_pylist() for c in rb.slice(at, 512).columns), strict=True):
                    if key != conv:
                        conv, part, state = key, 0, "start"
                    state = state and next_state(state, role)
                    out.append((key, part, turn, role, state is not None, [{"text": t, "loss": loss} for t, loss in template.segments(role, text)]))
                    part += 1
                yield batch(schema, *map(list, zip(*out, strict=True)))

    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return flat.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, read back from format_conversations' output (its order within partitions): conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = (), None
        for rb in it:
            out = []
            for key, part, valid, segments in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if key != conv or part == 0:
                    if now:
                        out.append(_done(conv, now))
                    conv, now = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(s["text"] for s in segments)
                for role, text in template.read(whole):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned = template.unquote("".join(s["text"] for s in segments if s["loss"]))
                now[2] += len(learned)
                now[3].update(learned.encode("utf-8", "surrogatepass"))
                now[4] += len(whole)
                now[5] = valid
            if out:
                yield batch(schema, *map(list, zip(*out, strict=True)))
        if now:
            yield batch(schema, *([x] for x in _done(conv, now)))

    return formatted.select("conv_id", "part", "valid", "segments").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _done(conv, now) -> tuple:
    return conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5]
