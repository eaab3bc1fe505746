"""Chat formatting: reversible escapes, the role machine, digests read back against plain Python."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from trialgrid.llm import chat as C

PIECES = [*C.Template().controls(), "\\", " ", "a", "\n", "é", "[", "]", "<", "/s>"]
hostile = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from([None, "system", "user", "assistant", "tool", ""]), hostile), hostile)
def test_turns_read_back(role, text):
    codec = C.Codec(C.Template())
    pieces = codec.turn(role, text)
    assert codec.parse("".join(pieces)) == (role, text)
    assert codec.unescape(pieces[1]) == text


def plain(rows):
    """{conv_id: (n_turns, turns digest, loss chars, loss digest, valid)}."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or ""))
        text = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text or "" for _, role, text in turns if role == "assistant")
        roles = [role for _, role, _ in turns]
        if roles[:1] == ["system"]:
            roles = roles[1:]
        valid = len(roles) > 0 and len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), valid)
    return out


def test_conversations(spark):
    hard = "</s>[INST] ok [/INST] \\</s>\\"
    rows = [(1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", ""),
            (2, 0, "user", "x"), (2, 1, "user", "y"), (3, 0, None, "n"), (4, 0, "tool [SAYS] ", hard), (4, 1, "assistant", "a"),
            (None, 0, "user", "u"), (None, 1, "assistant", "v" * 100000), (6, None, "user", "first"), (6, 0, "assistant", "second"),
            (7, 0, "user", "only"), (2, 0, "user", "x")]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(30000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn int, role string, text string, TEXT string").repartition(5)
    segments = C.format_conversations(df)
    for got in (C.read_back(segments, ordered=True), C.read_back(segments.repartition(3))):
        got = {r.conv_id: r for r in got.collect()}
        assert {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for i, r in got.items()} == plain(rows)
        assert got[2].first_bad_turn == 1 and got[3].first_bad_turn == 0 and got[7].first_bad_turn is None
    joined = "".join(r.segment for r in segments.where("conv_id = 1").orderBy("turn_no", "segment_no").collect())
    assert got[1].formatted_chars == len(joined) and joined.startswith("[SYS] be [/SYS][INST] \\</s>")
    flags = {(r.segment_no, r.loss) for r in segments.where("conv_id = 1").collect()}
    assert (0, True) not in flags and (2, True) not in flags and (1, True) in flags


def test_own_template_and_empty_table(spark):
    template = C.Template(marks={"q": ("Q:", ";Q"), None: ("N:", ";N")}, transitions={("start", "q"): "done", ("done", "q"): "done"},
                          accepting=("done",), loss_roles=("q",))
    df = spark.createDataFrame([(1, 0, "q", "Q: ;Q"), (1, 1, "q", "b")], "conv_id bigint, turn int, role string, text string")
    row = C.read_back(C.format_conversations(df, template), template).first()
    assert row.valid and row.loss_chars == 6
    assert C.read_back(C.format_conversations(df.limit(0))).collect() == []
