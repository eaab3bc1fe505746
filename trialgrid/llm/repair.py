"""Conversation structure repair.

A conversation is sound when the first letters of its roles read
`(s?(ua)+)?`: an optional system turn, then user and assistant in turns, or
nothing at all. A row may be kept (free), given the role the grammar expects,
user or assistant (`REROLE`), or deleted (`DELETE`, which blank and duplicate
rows must be); an empty user or assistant row may be inserted anywhere
(`INSERT`); a truncated row that stays adds `TRUNCATED`. The repair is the
cheapest list of edits, among equals the one whose initials (D, I, K, R) are
least as text. From one grammar state each kind of edit leads to one other
state, so the initials fix the result, and a tie is settled by the first edit.

What the repair depends on is a conversation's signature: a letter per row for
its role and fault. All distinct signatures form an automaton that shares
suffixes: a node is a suffix, reached by one letter from the node of the
shorter suffix. Signatures are sorted from their ends, so that a task visits
every node of its range once; each node holds, for the four grammar states,
the cost-to-go and the best next edits, which lead on into the node after it.
Equal nodes (same costs but for a constant, same next edits) are one object.
The audits found there are joined back to the conversations and
applied to their rows as these stream by, in order.

Order of rows: turn (nulls first), then role and digest of the text as they
came, copies beside each other. A row's faults, first one counts: blank (no
character but white space), duplicate (role and text seen in an earlier row),
truncated (last character that isn't white space is not one of `.!?`).

Defined cases: null roles and texts are one space; rows of a null conversation
id are one conversation; no rows: zeros, empty audit, the digest of an empty
text; repeated rows are duplicates; an empty table gives an empty result;
other columns never matter. A conversation is repaired in one task, as its
digest needs its rows in order, but as a stream: what is held is its
signature and its audit, a byte or two per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import pick
from trialgrid.session import written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant turn leads to, and the states that a conversation may end in.
EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Signature letters: s, u, a and o (another role), in capitals if truncated; x must go.
LOST = "x"
SALTS = 8


# --- the automaton ----------------------------------------------------------

def _settled(options: list[list[tuple[int, str, int | None]]]) -> tuple[tuple[int, ...], tuple[tuple[str, int | None], ...]]:
    """Cost and (initials, next state) per grammar state, from the options without
    inserts; an insert leads to another state of the same node. The next state is
    None at the end of the conversation."""
    best = [min(o) if o else None for o in options]
    for _ in range(3):  # at most two inserts in a row pay
        for state in range(4):
            via = best[EXPECTED[state]]
            if via is not None:
                found = (via[0] + INSERT, "I" + via[1], via[2])
                best[state] = found if best[state] is None else min(best[state], found)
    return tuple(b[0] for b in best), tuple((b[1], b[2]) for b in best)


class Node:
    """A suffix of signatures: least cost-to-go and best edits per grammar state."""

    __slots__ = ("base", "shape")

    def __init__(self, base: int, shape: tuple):
        self.base, self.shape = base, shape  # costs are base + shape[0][state]; edits are shape[1][state]


class Automaton:
    """Nodes built from the end; the work for a letter is done once per shape of the node after it."""

    def __init__(self):
        self._shapes = {}
        costs, edits = _settled([[(0, "", None)] if s in ENDS else [] for s in range(4)])
        self.end = Node(0, (costs, edits))

    def before(self, letter: str, node: Node) -> Node:
        """The node that reads `letter` and goes on as `node`."""
        key = (letter, node.shape[0])
        known = self._shapes.get(key)
        if known is None:
            after, late = node.shape[0], TRUNCATED if letter.isupper() else 0
            options = []
            for state in range(4):
                edits = [(DELETE + after[state], "D", state)]
                if letter != LOST:
                    kept = KEEPS.get((state, letter.lower()))
                    if kept is not None:
                        edits.append((late + after[kept], "K", kept))
                    edits.append((REROLE + late + after[EXPECTED[state]], "R", EXPECTED[state]))
                options.append(edits)
            costs, best = _settled(options)
            least = min(costs)
            known = self._shapes[key] = (least, (tuple(c - least for c in costs), best))
        return Node(node.base + known[0], known[1])


def _audit(path: list[Node]) -> str:
    """The best edits from the last node of `path` on, through the ones before it."""
    state, parts = START, []
    for node in reversed(path):
        initials, state = node.shape[1][state]
        parts.append(initials)
    return "".join(parts)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    path, read = [automaton.end], ""  # path[i] is the node of the last i letters of the signature at hand
    for batch in batches:
        signatures, costs, audits = [], [], []
        for turned in batch.column(0).to_pylist():
            shared = 0
            for a, b in zip(read, turned):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            for letter in turned[shared:]:
                path.append(automaton.before(letter, path[-1]))
            read = turned
            signatures.append(turned[::-1])
            costs.append(path[-1].base + path[-1].shape[0][START])
            audits.append(_audit(path))
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(costs, pa.int64()),
                                          pa.array(audits, pa.string())], ["signature", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct `signature`."""
    turned = signatures.select(F.reverse("signature").alias("turned")).distinct()
    return (turned.repartitionByRange("turned").sortWithinPartitions("turned")
            .mapInArrow(_audits, "signature string, cost bigint, audit string"))


# --- rows -------------------------------------------------------------------

def _texts(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role and text without nulls in the last two, and what orders rows of a turn."""
    space = F.lit(" ")
    return pick(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text")).withColumn(
        "place", F.concat("role", F.lit("\n"), F.sha2("text", 256)))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The rows (conv, turn, role, text, place, there) with faults put in by the
    checksum of `conv:turn` modulo 20: 0 drops a row (it stays with `there`
    false, so that its conversation isn't forgotten), 1 empties its text, 2
    takes its `.!?` out, 3 repeats it, 4 makes it the user's."""
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _texts(conversations, conv_col, turn_col, role_col, text_col).withColumn("kind", F.crc32(name) % 20)
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), "place", (F.col("kind") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def undamaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form that `repair` reads."""
    return _texts(conversations, conv_col, turn_col, role_col, text_col).withColumn("there", F.lit(True))


ORDER = ["turn", "place"]
NOT_SPACE = r"[^\x20\x09-\x0D]"


def with_letters(rows: DataFrame) -> DataFrame:
    """`rows` with the `letter` of each row's role and fault, and `fault` itself
    (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    # rows of equal role and text lie side by side: the first of them in order is no duplicate
    alike = Window.partitionBy("conv", "there", "role", "digest").orderBy(*ORDER)
    seen = F.row_number().over(alike) > 1
    fault: Column = (F.when(~F.col("text").rlike(NOT_SPACE), 1).when(seen, 2)
                     .when(F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0))
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    return (rows.withColumn("digest", F.sha2("text", 256)).withColumn("fault", fault)
            .withColumn("letter", F.when(F.col("fault").isin(1, 2), F.lit(LOST)).when(F.col("fault") == 3, F.upper(initial))
                        .otherwise(initial)).drop("digest"))


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature) of every conversation, empty for one whose rows are all gone."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, letters, convs, found = None, [], [], []
        for batch in batches:
            for conv, letter in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if current != (conv,):
                    if current:
                        convs.append(current[0])
                        found.append("".join(letters))
                    current, letters = (conv,), []
                letters.append(letter)
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(found, pa.string())], ["conv", "signature"])
                convs, found = [], []
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int64()), pa.array(["".join(letters)], pa.string())],
                                             ["conv", "signature"])

    letters = rows.select("conv", F.when(F.col("there"), F.col("letter")).otherwise(F.lit("")).alias("letter"), *ORDER)
    return _dealt(letters, *ORDER).select("conv", "letter").mapInArrow(gather, "conv bigint, signature string")


def plans(of_conversations: DataFrame) -> DataFrame:
    """(conv, cost, audit): the audit of each conversation's signature. Signatures
    that many conversations share meet them under a salt."""
    found = audits(of_conversations.select("signature")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = of_conversations.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))
    return salted.join(found, ["signature", "salt"]).select("conv", "cost", "audit")


STEPS = pa.schema([("conv", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
                   ("text", pa.string()), ("fault", pa.int32()), ("repaired_role", pa.string()), ("cost", pa.int64()),
                   ("audit", pa.string())])
STEPS_DDL = ("conv bigint, step bigint, edit string, turn bigint, role string, text string, fault int, repaired_role string, "
             "cost bigint, audit string")
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 22


def _tables(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded size."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(v) for v in row if isinstance(v, str))
        if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)


class _Applied:
    """The edits of one conversation, applied to its rows as they stream by."""

    def __init__(self, conv, cost: int, audit: str):
        self.conv, self.cost, self.audit = conv, cost, audit
        self.state, self.step, self.at = START, 0, 0

    def head(self) -> tuple:
        return (self.conv, 0, None, None, None, None, None, None, self.cost, self.audit)

    def _next(self, edit, turn, role, text, fault, repaired_role) -> tuple:
        self.step, self.at = self.step + 1, self.at + 1
        return (self.conv, self.step, edit, turn, role, text, fault, repaired_role, None, None)

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.state = EXPECTED[self.state]
            yield self._next("I", None, None, "", None, ROLE[self.state])

    def row(self, turn, role: str, text: str, fault: int) -> Iterator[tuple]:
        yield from self.inserts()
        edit, kept = self.audit[self.at], None
        if edit == "K":
            self.state, kept = KEEPS[self.state, role[:1]], role
        elif edit == "R":
            self.state = EXPECTED[self.state]
            kept = ROLE[self.state]
        yield self._next(edit, turn, role, text, fault, kept)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def steps() -> Iterator[tuple]:
        current = None
        for batch in batches:
            for conv, cost, audit, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is None:
                    yield from current.row(turn, role, text, fault)
                    continue
                if current is not None:  # a conversation's plan comes before its rows
                    yield from current.inserts()
                current = _Applied(conv, cost, audit)
                yield current.head()
        if current is not None:
            yield from current.inserts()

    yield from _tables(steps(), STEPS)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of `rows` (from `damaged` or `undamaged`), in order: one row (conv, step, edit,
    turn, role, text, fault, repaired_role) per edit, its role as it was and as it is now (null: deleted), before them
    step 0 with the cost and the initials of all. A conversation's steps lie in order in one partition."""
    marked = written(with_letters(rows), "turns", "zstd")
    plan = plans(written(signatures(marked), "signatures", "zstd"))
    empty = F.lit(None)
    stream = plan.select("conv", "cost", "audit", empty.cast("bigint").alias("turn"), empty.cast("string").alias("role"),
                         empty.cast("string").alias("text"), empty.cast("int").alias("fault"), F.lit("").alias("place"),
                         F.lit(0).alias("rank")).unionByName(
        marked.where("there").select("conv", empty.cast("bigint").alias("cost"), empty.cast("string").alias("audit"), "turn",
                                     "role", "text", "fault", "place", F.lit(1).alias("rank")))
    return (_dealt(stream, "rank", *ORDER).select("conv", "cost", "audit", "turn", "role", "text", "fault")
            .mapInArrow(_apply, STEPS_DDL))


def repaired_conversations(steps: DataFrame) -> DataFrame:
    """The repaired rows: conv, step (rising), role, text."""
    return steps.where(F.col("repaired_role").isNotNull()).select("conv", "step", F.col("repaired_role").alias("role"), "text")


RESULT = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    ("audit", pa.string()), ("repaired_sha256", pa.string())])
RESULT_DDL = ("conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
              "audit string, repaired_sha256 string")


class _Facts:
    """What is reported of one conversation, from its steps."""

    def __init__(self, conv, cost: int, audit: str):
        self.conv, self.cost, self.audit = conv, cost, audit
        self.lines, self.digest, self.faults, self.illegal, self.initial = 0, hashlib.sha256(), [0, 0, 0, 0], 0, None
        self.low, self.high, self.turns = None, None, 0

    def step(self, edit: str, turn, role, text: str, fault, repaired_role) -> None:
        if edit != "I":
            if turn is not None and turn != self.high:  # turns come in order
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            self.faults[fault] += 1
        if repaired_role is not None:
            self.digest.update((("\n" if self.lines else "") + f"{repaired_role}:{text}").encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit, self.digest.hexdigest())


def summary(steps: DataFrame, conv_col: str = "conv_id", ordered: bool = False) -> DataFrame:
    """One row per conversation: gaps between its turns, its faults, pairs of neighbours that the grammar doesn't
    have, cost and initials of the edits, digest of the repaired `role:text` lines. `ordered`: `steps` as `repair`
    leaves them; else they are dealt and sorted first."""
    if not ordered:
        steps = _dealt(steps, "step")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current = None
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(len(STEPS))]
                for conv, step, edit, turn, role, text, fault, repaired_role, cost, audit in zip(*columns, strict=True):
                    if step:
                        current.step(edit, turn, role, text, fault, repaired_role)
                        continue
                    if current is not None:
                        yield current.row()
                    current = _Facts(conv, cost, audit)
            if current is not None:
                yield current.row()

        yield from _tables(rows(), RESULT)

    return steps.mapInArrow(facts, RESULT_DDL).withColumnRenamed("conv", conv_col)
