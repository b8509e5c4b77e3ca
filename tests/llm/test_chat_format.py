import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chat_format as chat

PIECES = ["<", "|", "turn", "|>", "end", "</s>", "<s>", "[INST]", "[/INST]", "\\", ":", "\n", "a", "é", "<|turn|>", "<|end|>", "\r", "[", "/"]
TEXTS = st.text(st.characters(codec="utf-8")) | st.lists(st.sampled_from(PIECES)).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_rendering_can_be_read_back(messages):
    text, starts, ends = chat.render(messages, loss_role="assistant")
    assert chat.parse(text) == messages
    assert all(c not in chat.escape(t) for _, t in messages for c in chat.CONTROL)


def test_fold_of_events():
    e = [("message", 1, "user", "hi"), ("message", 2, "assistant", ""), ("delta", 2, None, "he"), ("delta", 2, None, "llo"), ("edit", 1, None, "hey"), ("message", 3, "user", "more"), ("regenerate", 2, None, ""), ("delta", 2, None, "new"), ("delete", 9, None, None), ("delta", 5, "user", "late")]
    assert chat.fold(*map(list, zip(*e, strict=True))) == [("user", "hey"), ("assistant", "new"), ("user", "late")]


def test_query_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", ""), (2, 0, "user", "u"), (2, 0, "user", "u")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.from_turns(turns))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (sha("user\n\nassistant\nb</s>\n"), 5, sha("b</s>"))
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[None]["loss_chars"] == 0
    assert got[2]["n_turns"] == 3
    assert chat.format_chats(chat.from_turns(turns.limit(0))).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    from pagewright.llm.queries import QUERIES

    turns = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: r["turn"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: r for r in QUERIES["op2_chat_format"](spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert got[k]["n_turns"] == len(t) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_streamed_events_fold_back(spark):
    rows = [(1, 1, "assistant", "b</s>é"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", ""), (2, 0, "user", "u"), (2, 0, "user", "u"), (2, 0, "assistant", "four")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = lambda events: sorted(map(str, chat.digests(chat.format_chats(events)).collect()))
    assert read(chat.as_streamed(turns)) == read(chat.from_turns(turns))
    assert {r["kind"] for r in chat.as_streamed(turns).collect()} == {"message", "edit", "regenerate", "delta"}


def test_long_edited_conversation(spark):
    n = 20_000
    events = [(1, i, "message", i, "user", "a") for i in range(n)] + [(1, n + i, "edit", i, None, f"b{i}") for i in range(n)] + [(1, 2 * n + i, "delete", 2 * i, None, None) for i in range(n // 2)]
    assert chat.fold(*map(list, zip(*[e[2:] for e in events], strict=True))) == [("user", f"b{i}") for i in range(1, n, 2)]
