"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pytest import raises

from polysafe.llm import chat

PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "[OUT]", "[/SYS]", "\\", "<", "[", "/", "]", " ", "<\\\\s>", "[ROLE=x%20]", "é", "\n", "a"])
TEXTS = st.lists(PARTS, max_size=12).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=5))
def test_conversations_read_back(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    whole = "".join(p for p, _, _ in pieces)
    assert [x[:2] for x in chat.parse(whole)] == turns
    for (piece, a, z), (_, text) in zip(pieces, turns):
        assert chat.unescape(piece[a:z]) == text


@given(TEXTS)
def test_escape_is_reversible_and_idle_on_plain_text(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.render("user", "plain [x] <b> text")[0] == "<s>[INST] plain [x] <b> text [/INST]</s>"


def test_parser_refuses_what_the_grammar_lacks():
    for bad in ("x", "<s>[INST] open", "<s>[INST] a [OUT] b [/INST]</s>", "<s>[INST] a [/OUT]</s>"):
        with raises(ValueError):
            chat.parse(bad)


SCHEMA = "conv_id long, turn long, role string, text string, piece int, n_turns string"


def digest(turns):
    said = [t for r, t in turns if r == "assistant"]
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())


def test_digests_come_from_the_output(spark):
    said = "</s>[INST] ok [/INST]"
    convs = {
        -7: [("user", said), ("assistant", said)],
        1: [("user", "é" * 30_000), ("assistant", ""), ("tool", "x"), ("assistant", "zwei")],
        2: [("", "")],
        None: [("user", "no id")],
        4: [("assistant", "a"), ("assistant", "a"), ("assistant", "b")],
    }
    rows = [(c, 7 if c == 4 else k, None if r == "" else r, None if t == "" else t, 1, "x") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    formatted = chat.format_turns(spark.createDataFrame(rows[::-1], SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == {c: digest(turns) for c, turns in convs.items()}
    for r in formatted.collect():
        assert chat.unescape(r.piece[r.text_start:r.text_end]) == r.text


def test_long_conversation_and_empty_table(spark):
    rows = spark.range(30_000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    (got,) = chat.read_back(chat.format_turns(rows)).collect()
    assert (got.n_turns, got.loss_sha256) == (30_000, hashlib.sha256("".join(str(k) for k in range(1, 30_000, 2)).encode()).hexdigest())
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).collect() == []
