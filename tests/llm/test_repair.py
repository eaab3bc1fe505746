"""Conversation repair: the automaton against a search over all edits, whole conversations against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trialgrid.llm import repair as R

NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def search(rows):
    """Least (cost, audit) and its lines, by trying edits in order of cost and initials; rows are (role, text, fault)."""
    heap, n = [(0, "", 0, "", ())], len(rows)
    done = set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == n and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        role = NEXT[last]
        heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*lines, role + ":")))
        if i < n:
            was, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if fault not in (1, 2):
                late = int(fault == 3)
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, role[0], (*lines, f"{role}:{text}")))
                if was[:1] == role[0] or (was[:1] == "s" and last == "" and not lines):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, was[0], (*lines, f"{was}:{text}")))
    raise AssertionError


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("suaoSUAOx", max_size=7), min_size=1, max_size=8))
def test_automaton(signatures):
    turned = sorted({s[::-1] for s in signatures})
    got = [row for b in R._audits(iter([pa.RecordBatch.from_arrays([pa.array(turned)], ["t"])])) for row in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == len(turned)
    for signature, cost, audit in got:
        rows = [(c.lower(), "", 1 if c == "x" else 3 if c.isupper() else 0) for c in signature]
        assert (cost, audit) == search(rows)[:2]


def test_nodes_are_shared():
    """A suffix is built once, and equal nodes are one shape."""
    made = []
    class Counted(R.Automaton):
        def before(self, letter, node):
            made.append(letter)
            return super().before(letter, node)
    words = sorted({("ua" * k + "su" * j)[::-1] for k in range(6) for j in range(3)})
    R_automaton, R.Automaton = R.Automaton, Counted
    try:
        list(R._audits(iter([pa.RecordBatch.from_arrays([pa.array(words)], ["t"])])))
    finally:
        R.Automaton = R_automaton
    assert len(made) == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    automaton, node = R.Automaton(), R.Automaton().end
    for _ in range(1000):
        node = automaton.before("a", automaton.before("u", node))
    assert len(automaton._shapes) < 20


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        given_rows = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        for turn, role, text in sorted(given_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] + "\n" + hashlib.sha256(r[2].encode()).hexdigest())):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        seen, judged = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            judged.append((role, text, 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults = [sum(f == k for _, _, f in judged) for k in (1, 2, 3)]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = search(judged)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_against_plain(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", None, " \n", "Ω!", "a.b", "Why? ", "x" * 50000 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    rows = [(c, t, rng.choice(roles[:3] * 4 + roles), rng.choice(texts)) for c in range(120) for t in sorted(rng.sample(range(14), rng.randint(1, 9)))]
    rows += [(200, None, "user", "Hi."), (200, 3, "assistant", "No."), (200, 3, "assistant", "No."), (None, 0, "user", "u."), (None, None, None, None)]
    rows += [(300, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi."))
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, Role2 string").toDF(
        "conv_id", "turn", "role", "text", "ROLE").repartition(5)
    steps = R.repair(R.damaged(df))
    want = plain(rows)
    for facts in (R.summary(steps, ordered=True), R.summary(steps.repartition(3))):
        got = {r.conv_id: tuple(r)[1:] for r in facts.collect()}
        assert got == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    lines = R.repaired_conversations(steps).where("conv = 300").orderBy("step").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == want[300][-1]


def test_as_they_are_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "No."), (2, 0, "assistant", "Hm")],
                               "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in R.summary(R.repair(R.undamaged(df))).collect()}
    assert got == {1: (0, "KK"), 2: (3, "D")}  # as dear as an insert before a truncated row, and D comes first
    assert R.summary(R.repair(R.damaged(df.limit(0)))).collect() == []
