import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import chat

MARKS = st.lists(st.sampled_from(["\\", "###", "</turn>", "\n", " ", "a", "### Assistant: ", '"', ": ", "é"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.sampled_from(["user", "assistant", "User", "", "a: b"]), MARKS), MARKS)
def test_every_turn_reads_back(role, text):
    s, start, end = chat.format_turn(role, text)
    assert chat.recovered(s) == (role, text)
    assert chat.unescape(s[start:end]) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x"]), MARKS), max_size=5))
def test_turns_read_back_from_their_concatenation(turns):
    whole, at, got = "".join(chat.format_turn(r, t)[0] for r, t in turns), 0, []
    while at < len(whole):
        role, start, end, at = chat.parse_one(whole, at)
        got.append((role, chat.unescape(whole[start:end])))
    assert got == turns


def test_plain_text_is_left_alone():
    assert chat.format_turn("user", "a \\ b")[0] == "### User: a \\ b\n</turn>\n"


def test_broken_text_is_refused():
    with pytest.raises(chat.Malformed):
        chat.parse_one("nonsense here")


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "two", "x"), (1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, None, None, "only", "x"),
        (2, 0, "assistant", "### User: a\n</turn>\n", "x"), (2, 0, "assistant", "A", "x"), (3, 0, "user", "z" * 100_000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nuser\n\nassistant\ntwo\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, sha("two"))
    assert got[2].turns_sha256 == sha("assistant\nA\nassistant\n### User: a\n</turn>\n\n") and got[2].loss_chars == 21
    assert got[None].n_turns == 1 and got[3].loss_chars == 0
    assert got[3].formatted_chars == 100_000 + len("### User: \n</turn>\n")
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
