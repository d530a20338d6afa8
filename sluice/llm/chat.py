"""Operator 2: chat formatting by a finite-state machine over roles.

A declarative `Template` names for each role how a turn opens and closes and whether
its text bears loss, and which role may follow which. The machine walks the turns of
a conversation, and the operator emits text segments, each with its loss flag, and the
state after the turn. Markers never occur inside texts: `\\` and every control
string are escaped, and `Template.unescape` takes that back exactly.

Defined cases: null texts and null roles are empty strings; a role that the template
does not know is written under the template's `other` form with its name escaped and
makes the conversation invalid, as does a turn out of order (later turns are still
formatted, so nothing is lost); null turns come first; ties in turn and repeated rows are
ordered by role and text; rows with a null conv_id form one conversation; an empty table
gives an empty result; other columns are not read.

A conversation is streamed: rows are dealt by conv_id and sorted, and memory holds an
Arrow batch and one turn whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns


@dataclass(frozen=True)
class Template:
    """roles: name -> (opening, loss flag). follow: state -> roles that may come next;
    a state is the role before, `start` at first. final: states that may end."""

    roles: Mapping[str, tuple[str, bool]] = field(default_factory=lambda: {
        "system": ("### System: ", False), "user": ("### User: ", False),
        "assistant": ("### Assistant: ", True), "tool": ("### Tool: ", False),
    })
    other: tuple[str, str] = ("### Role ", ": ")
    close: str = " </turn>\n"
    #: Strings that may not stand in a text, and what stands for them.
    control: Mapping[str, str] = field(default_factory=lambda: {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ": ": "\\c"})
    follow: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant",),
    })
    final: tuple[str, ...] = ("assistant", "user")

    def _swap(self, text: str, pairs: Mapping[str, str]) -> str:
        return re.sub("|".join(re.escape(k) for k in pairs), lambda m: pairs[m[0]], text)

    def escape(self, text: str, name: bool = False) -> str:
        """`name`: also the string that ends a role's name."""
        return self._swap(text, {k: v for k, v in self.control.items() if name or k != ": "})

    def unescape(self, text: str) -> str:
        return self._swap(text, {v: k for k, v in self.control.items()})

    def step(self, state: str, role: str) -> str:
        """The state after a turn of `role`; `invalid` is never left."""
        return role if role in self.follow.get(state, ()) else "invalid"

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as (text, bears loss): opening, text, closing."""
        known = self.roles.get(role)
        opening, loss = known if known else (self.other[0] + self.escape(role, True) + self.other[1], False)
        return [(opening, False), (self.escape(text), loss), (self.close, False)]

    def turn(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn, read from its characters alone."""
        body = formatted[: -len(self.close)]
        for role, (opening, _) in self.roles.items():
            if body.startswith(opening):
                return role, self.unescape(body[len(opening) :])
        name, _, text = body[len(self.other[0]) :].partition(self.other[1])
        return self.unescape(name), self.unescape(text)


SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, state string"


def format_chat(conversations: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of all conversations. Those of a conversation stand together, in
    order, in one partition; their texts joined are the formatted conversation."""
    template = template or Template()
    rows = conversations.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(parts: Iterator[list[list]]) -> Iterator[list]:
        now, state, number = object(), "start", 0
        for conv_id, _, roles, texts in parts:
            out = []
            for key, said, words in zip(conv_id, roles, texts):
                if key != now:
                    now, state, number = key, "start", 0
                state = template.step(state, said)
                out += [(key, number, k, s, loss, state) for k, (s, loss) in enumerate(template.segments(said, words))]
                number += 1
            yield zip(*out)

    return map_columns(rows, run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, from the output of `format_chat` only."""
    template = template or Template()

    def run(parts: Iterator[list[list]]) -> Iterator[list]:
        now, tally = object(), None
        pieces: list[str] = []

        def done() -> tuple:
            turns, all_turns, loss, all_loss, chars, state = tally
            return now, turns, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars, state in template.final

        for conv_id, texts, losses, states in parts:
            out = []
            for key, part, bears, state in zip(conv_id, texts, losses, states):
                if key != now:
                    if tally:
                        out.append(done())
                    now, tally = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, "start"]
                tally[4] += len(part)
                tally[5] = state
                if bears:
                    plain = template.unescape(part)
                    tally[2] += len(plain)
                    tally[3].update(plain.encode())
                pieces.append(part)
                if part == template.close:
                    said, words = template.turn("".join(pieces))
                    pieces.clear()
                    tally[0] += 1
                    tally[1].update(f"{said}\n{words}\n".encode())
            if out:
                yield zip(*out)
        if tally:
            yield zip(*[done()])

    return map_columns(segments.select("conv_id", "text", "loss", "state"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
