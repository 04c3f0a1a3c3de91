import hashlib

from hypothesis import given, settings, strategies as st

from packetloom.llm import chat

PIECES = [*chat.CONTROL, "\\", "<", "[", "|", ">", "a", "é", "\n", "n", "\\n", "</", "s>", "<think>x</think>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=6).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\\nb\nc", "<|turn|>"]), TEXT), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_round_trip_and_spans(turns):
    out, spans, rewrites = chat.render(turns)
    assert rewrites == -1 and chat.parse(out) == turns
    assert [chat.unescape(out[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert [a for a, *_ in spans] == [0, *[b for _, b, *_ in spans]][:len(spans)]
    for _, _, c, d in spans:
        assert not any(x in out[c:d] for x in chat.CONTROL)


def test_rewriting_templates_are_found():
    turns = [("user", "q"), ("assistant", "<think>a</think>b"), ("user", "r"), ("assistant", "s")]
    out, spans, at = chat.render(turns, chat.without_earlier_thoughts)
    assert at == 3 and len(spans) == 3 and out == chat.without_earlier_thoughts(turns)
    assert chat.render([turns[0], ("assistant", "b"), *turns[2:]], chat.without_earlier_thoughts)[2] == -1
    shouting = lambda ts: "".join(f"[{r}]{'' if r == 'system' else t}" for r, t in ts)
    assert chat.render([("system", "hidden"), ("user", "hi")], shouting)[1] == [(0, 8, 8, 8), (8, 16, 14, 16)]


def test_formatting(spark):
    rows = [(1, 1, "assistant", "b</s>", 1), (1, 0, "user", None, 1), (2, 0, "assistant", "x", 1), (2, 0, "assistant", "a", 1), (None, None, None, "lost", 1), (3, 5, "assistant", "y" * 300_000, 1),
            *[(9, i, "user" if i % 2 else "assistant", f"t{i}", 1) for i in range(300)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, None, 3, 9}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\n\nassistant\nb</s>\n"), 5, sha("b</s>"))
    assert got[2].loss_sha256 == sha("ax") and got[None].loss_chars == 0 and got[3].loss_chars == 300_000
    assert got[9].loss_sha256 == sha("".join(f"t{i}" for i in range(0, 300, 2)))
    flags = {r.conv_id: r.rewrites_at for r in chat.format_conversations(
        spark.createDataFrame([(1, 0, "assistant", "<think>z</think>ok", 0), (1, 1, "assistant", "ok", 0), (2, 0, "user", "q", 0)], df.schema), chat.without_earlier_thoughts).collect()}
    assert flags == {1: 1, 2: None}
    assert chat.conversation_digests(chat.format_conversations(df.filter("false"))).count() == 0
