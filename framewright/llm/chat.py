"""Chat formatting by a finite-state machine over roles.

A declarative template gives, per role, the strings that open and close a turn and whether its
text is trained on. Control strings inside texts are escaped reversibly: a backslash is doubled
and one is put after the first character of every control string. Rows are dealt by
conversation and streamed in turn order, so a conversation of any length needs constant memory;
its digest is sequential by definition, which keeps one conversation in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role; ``other`` formats any role that has no turn of its own, with the role's name."""

    roles: dict[str, Turn]
    other: tuple[str, str, str] = ("<<ROLE>> ", "\n", " <</ROLE>>")
    controls: tuple[str, ...] = ()
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    finals: tuple[str, ...] = ()

    def pattern(self) -> re.Pattern:
        return re.compile("|".join([r"\\", *(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))]))


INSTRUCT = Template(
    roles={
        "system": Turn("<<SYS>> ", " <</SYS>>"),
        "user": Turn("<s>[INST] ", " [/INST]"),
        "assistant": Turn(" ", " </s>", loss=True),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"),
    moves={
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    finals=("assistant",),
)


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def segments(role: str | None, text: str | None, template: Template, pattern: re.Pattern) -> list[tuple[str, bool]]:
    """(text, loss) pieces of one turn; a null role is an empty name, a null text an empty text."""
    turn, text = template.roles.get(role or ""), escape(text or "", pattern)
    if turn is None:
        opens, named, closes = template.other
        return [(opens + escape(role or "", pattern).replace("\n", "\\\n") + named, False), (text, False), (closes, False)]
    return [(turn.opens, False), (text, turn.loss), (turn.closes, False)]


def parse(formatted: str, template: Template) -> tuple[list[tuple[str, str, bool]], int]:
    """Turns (role, text, loss) of a formatted string and how far they reach; raises on anything else."""
    turns, at = [], 0
    opening = sorted([(t.opens, r) for r, t in template.roles.items()] + [(template.other[0], None)], key=lambda x: -len(x[0]))
    while at < len(formatted):
        found = next(((o, r) for o, r in opening if formatted.startswith(o, at)), None)
        if found is None:
            raise ValueError(f"no turn opens at {at}")
        start, role = at + len(found[0]), found[1]
        if role is None:
            line = re.compile(r"(?:\\.|[^\\\n])*", re.S).match(formatted, start).end()
            role, start = unescape(formatted[start:line]), line + 1
            closes, loss = template.other[2], False
        else:
            closes, loss = template.roles[role].closes, template.roles[role].loss
        end = formatted.find(closes, start)
        if end < 0:
            raise ValueError(f"a turn opened at {at} doesn't close")
        turns.append((role, unescape(formatted[start:end]), loss))
        at = end + len(closes)
    return turns, at


SEGMENTS = "conv_id long, turn long, segment int, role string, text string, loss boolean, state string"


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per segment, in order within a task: conv_id, turn, segment, role, text, loss, state.

    ``state`` is the machine's state after the turn; ``error`` from the first turn out of order
    on (turns are still formatted). Rows of equal turn are ordered by role (null first), then
    text. A null conv_id is a conversation of its own. An empty table gives none.
    """
    pattern = template.pattern()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, template.start, False
        for batch in batches:
            out: list[tuple] = []
            ids, turns, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            for c, t, r, x in zip(ids, turns, roles, texts):
                if not begun or c != conv:
                    conv, state, begun = c, template.start, True
                state = template.moves.get((state, r or ""), "error")
                out += [(c, t, i, r, s, loss, state) for i, (s, loss) in enumerate(segments(r, x, template, pattern))]
            if out:
                yield _arrow(out)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(stream, SEGMENTS)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string())
    names = ("conv_id", "turn", "segment", "role", "text", "loss", "state")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class _Reader:
    """Reads one conversation's formatted output back, turn by turn, and digests it."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template = conv, template
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss, self.state, self.pending = hashlib.sha256(), hashlib.sha256(), template.start, []

    def add(self, text: str, loss: bool, closes: bool, state: str) -> None:
        self.chars += len(text)
        self.pending.append((text, loss))
        self.state = state
        if closes:
            formatted = "".join(t for t, _ in self.pending)
            masked = "".join(t for t, flag in self.pending if flag)
            for role, turn_text, _ in parse(formatted, self.template)[0]:
                self.turns += 1
                self.all.update(f"{role}\n{turn_text}\n".encode("utf-8", "surrogatepass"))
            plain = unescape(masked)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
            self.pending = []

    def row(self) -> dict:
        return {
            "conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": self.state in self.template.finals,
        }


def digest(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read back from the segments of ``format_conversations``.

    ``valid``: the machine accepted every turn and ended in a final state.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            cols = [batch.column(i).to_pylist() for i in (0, 2, 4, 5, 6)]
            for conv, segment, text, loss, state in zip(*cols):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss, segment == 2, state)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row()], schema=schema)

    return formatted.mapInArrow(stream, DIGEST)


#: The contract's own conversation: control strings as texts.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def format_all(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -1, the contract's own, which is a row of its own
    beside a conversation of the table that has this id.

    Null texts and roles are empty; null ids are one conversation; repeated rows are turns of their own;
    a very long text is one turn; extra columns are not read; an empty table gives conversation -1 alone."""
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string").coalesce(1)
    return digest(format_conversations(conversations)).unionByName(digest(format_conversations(probe)))
