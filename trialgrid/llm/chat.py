"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags per segment.

`format_conversations` sends each conversation through one task in turn order,
as a stream: the machine's state and the pieces of the current turn are all
that is held, so a conversation of any length fits. Each turn becomes three
segments (opening mark, body, closing mark) and only bodies of trained roles
carry loss. `read_back` parses that output again.

Texts are escaped reversibly: a control string in a text, after k backslashes,
gets one more backslash; a mark of the template has none before it, as a space
always stands between a text and the marks around it.

Defined cases: a null text is empty; a null role has marks of its own and reads
back as an empty role; a null conversation id is a conversation; null turns come
first; turns that tie are ordered by role, then text; repeated rows are repeated
turns; an empty table gives no segments; a conversation that breaks the turn
order is formatted all the same and reported as invalid from its first bad turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import pick

BACKSLASH = "\\"


@dataclass(frozen=True)
class Template:
    """Marks by role, the machine's transitions, and the roles that are trained on."""

    marks: dict = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("<s>", "</s>"),
        None: ("[ANON]", "[/ANON]"),
    })
    #: Any other role is written out between the first two marks.
    other: tuple = ("[ROLE]", "[SAYS]", "[/ROLE]")
    start: str = "start"
    transitions: dict = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    accepting: tuple = ("answered",)
    loss_roles: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))


class Codec:
    """Formats and parses single turns of a template."""

    def __init__(self, template: Template):
        self.t = template
        names = "|".join(re.escape(m) for m in template.controls())
        self.control = re.compile(rf"(\\*)({names})")
        self.role_of = {pair[0]: role for role, pair in template.marks.items()}

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: BACKSLASH + m[0], text)

    def unescape(self, text: str) -> str:
        def lower(m):
            if not m[1]:
                raise ValueError(f"unescaped control string {m[2]!r} in a text")
            return m[0][1:]
        return self.control.sub(lower, text)

    def turn(self, role: str | None, text: str) -> tuple[str, str, str]:
        """Opening mark, body and closing mark."""
        if role in self.t.marks:
            first, last = self.t.marks[role]
            head = f"{first} "
        else:
            first, middle, last = self.t.other
            head = f"{first} {self.escape(role)} {middle} "
        return head, self.escape(text), f" {last}"

    def parse(self, formatted: str) -> tuple[str | None, str]:
        """Role and text of one formatted turn."""
        bare = [(m.start(2), m[2]) for m in self.control.finditer(formatted) if not m[1]]
        first, last = bare[0], bare[-1]
        body_at, role = first[0] + len(first[1]) + 1, self.role_of.get(first[1])
        if first[1] == self.t.other[0]:
            middle = bare[1]
            role = self.unescape(formatted[body_at:middle[0] - 1])
            body_at = middle[0] + len(middle[1]) + 1
        return role, self.unescape(formatted[body_at:last[0] - 1])


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int32()),
                      ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])
SEGMENTS_DDL = "conv_id bigint, turn_no bigint, segment_no int, segment string, loss boolean, state string"
INVALID = "invalid"


def format_conversations(conversations: DataFrame, template: Template | None = None, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv_id, turn_no, segment_no, segment, loss, state), three per
    turn; `state` is the machine's state after the turn, `invalid` from the
    first turn on that the transitions don't allow. The segments of a
    conversation joined in order are its formatted text."""
    template = template or Template()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, state, number = Codec(template), (), template.start, 0
        for batch in batches:
            out = [[] for _ in SEGMENTS]
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if current != (conv,):
                    current, state, number = (conv,), template.start, 0
                state = template.transitions.get((state, role), INVALID)
                loss = role in template.loss_roles
                for k, piece in enumerate(codec.turn(role, text or "")):
                    for column, value in zip(out, (conv, number, k, piece, loss and k == 1, state), strict=True):
                        column.append(value)
                number += 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, SEGMENTS, strict=True)],
                                                 schema=SEGMENTS)

    turns = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    ordered = (turns.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.mapInArrow(segments, SEGMENTS_DDL)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                     ("valid", pa.bool_()), ("first_bad_turn", pa.int64())])
DIGESTS_DDL = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
               "formatted_chars bigint, valid boolean, first_bad_turn bigint")


def read_back(segments: DataFrame, template: Template | None = None, ordered: bool = False) -> DataFrame:
    """One row per conversation, parsed from the formatted segments: number of
    turns, digest of (role, newline, text, newline) per turn, length and digest
    of all text under the loss mask, length of the formatted text, and whether
    the machine ended in an accepting state (else the first bad turn; null if
    the conversation only stopped early). `ordered`: each conversation's
    segments lie in order in one partition, as `format_conversations` leaves
    them; else they are dealt and sorted first."""
    template = template or Template()
    if not ordered:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment_no")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, done, conversation = Codec(template), [], None

        def table():
            return pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in done], t.type) for i, t in enumerate(DIGESTS)], schema=DIGESTS)

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5))
            for conv, turn_no, segment_no, piece, loss, state in zip(*columns, strict=True):
                if conversation is None or conversation.conv != conv or (turn_no, segment_no) == (0, 0):
                    if conversation is not None:
                        done.append(conversation.row(template))
                    conversation = _Conversation(conv)
                conversation.add(codec, turn_no, segment_no, piece, loss, state)
            if len(done) > 1000:
                yield table()
                done = []
        if conversation is not None:
            done.append(conversation.row(template))
        if done:
            yield table()

    return segments.mapInArrow(digests, DIGESTS_DDL)


class _Conversation:
    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.pieces, self.state, self.bad = [], None, None

    def add(self, codec: Codec, turn_no: int, segment_no: int, piece: str, loss: bool, state: str) -> None:
        self.pieces.append(piece)
        self.chars += len(piece)
        if loss:
            text = codec.unescape(piece)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if state == INVALID and self.bad is None:
            self.bad = turn_no
        self.state = state
        if segment_no == 2:
            role, text = codec.parse("".join(self.pieces))
            self.pieces = []
            self.n_turns += 1
            self.turns.update(f"{role or ''}\n{text}\n".encode())

    def row(self, template: Template) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.state in template.accepting, self.bad)
