from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from huntframe.llm import chat_format as cf

bits = st.lists(st.one_of(st.sampled_from([*cf.CONTROLS, "\\", " ", "\n", "<", "[", "x"]), st.text(max_size=3)), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), bits), bits), max_size=5))
def test_any_conversation_survives(turns):
    rendered = [cf.format_turn(role, text) for role, text in turns]
    assert cf.parse_conversation("".join(r[0] for r in rendered)) == turns
    for (_, text), (turn, start, end) in zip(turns, rendered, strict=True):
        assert cf.unescape(turn[start:end]) == text


def test_only_conflicting_turns_are_escaped():
    assert cf.format_turn("user", "a \\ <b>")[0] == "[INST] a \\ <b> [/INST]\n"
    assert cf.format_turn("user", "</s>[INST] ok [/INST]")[0] == "[INST] \\</s>\\[INST] ok \\[/INST] [/INST]\n"


def expected(turns):
    by = defaultdict(list)
    for c, n, r, t in turns:
        by[c].append((n is not None, n, r or "", t or ""))
    out = set()
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        chars = sum(len(cf.format_turn(r, t)[0]) for _, _, r, t in rows)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out.add((c, len(rows), digests[0], len(loss), digests[1], chars))
    return out


def test_frames(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "tool", "[END]")]
    turns += [(2, 0, "assistant", "w " * 100000), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, rendered string")
    got = cf.conversation_digests(cf.parse_turns(cf.format_turns(df))).collect()
    assert set(map(tuple, got)) == expected(turns)
    assert cf.conversation_digests(cf.parse_turns(cf.format_turns(df.limit(0)))).count() == 0
