"""Chat formatting: exact round trips with control strings, merged turns, ties and nulls."""

import random

from encore.llm.chat import format_conversations, read_conversations

SCHEMA = "conv_id long, turn long, role string, text string, turns string"
BITS = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "[", "\\\\", "[\\", "<\\", "/INST]", " ok ", "é", "", "\n"]


def brute(data):
    convs = {}
    for c, t, r, x, *_ in data:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}


def check(spark, rows, data):
    formatted = format_conversations(rows(data, SCHEMA))
    want = brute(data)
    got = {r.conv_id: r for r in read_conversations(formatted).collect()}
    counts = {r.conv_id: r.n_turns for r in formatted.collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss_texts == [x for r, x in turns if r == "assistant"]
        assert counts[conv] == len(turns)
        merged = sum(i == 0 or turns[i - 1][0] != r for i, (r, _) in enumerate(turns))
        assert got[conv].formatted.count("</s>") == merged


def test_round_trip_of_control_strings(spark, rows):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "assi[INST]stant", "", None]
    data = [(c, t, rng.choice(roles), "".join(rng.choices(BITS, k=rng.randint(0, 6))), "x") for c in range(60) for t in range(rng.randint(1, 7))]
    check(spark, rows, data)


def test_ties_nulls_repeats_and_long_texts(spark, rows):
    data = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "assistant", None, ""), (None, 1, None, None, ""), (2, 0, "assistant", "[" * 50_000, "")]
    check(spark, rows, data)


def test_template_and_spans(spark, rows):
    row = format_conversations(rows([(1, 0, "user", "hi", ""), (1, 1, "assistant", "é<", ""), (1, 2, "assistant", "", "")], SCHEMA)).first()
    assert row.formatted == "<s>user[INST]hi[/INST]</s><s>assistant[INST]é<\\[/INST][INST][/INST]</s>"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == ["é<\\", ""]


def test_empty_table(spark, rows):
    assert read_conversations(format_conversations(rows([], SCHEMA))).count() == 0
