import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import chat
from pairlab.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXT = st.lists(st.sampled_from(["</s>", "<s>", "[INST] ", "[/INST]", "\\", "<", "<<SYS>>", "\n", "é", "a", "[HIST] ", "<|im_end|>", "/s>", "INST]"]), max_size=8).map("".join)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(m for m in chat.CONTROL.findall(escaped) if m != "\\")


@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_windows_read_back(turns):
    talk = chat._Conversation(1, 10**6, 10)
    rows = [r for role, text in turns for r in talk.add(role, text, 1)] + list(talk.flush(True))
    assert [t[1:] for r in rows for t in chat.read_back(r["text"]) if not t[0]] == turns


def brute(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests_and_budgets(spark):
    rows = []
    for conv in range(30):
        rows += [(conv, 0, "system", "be kind", 1)] if conv % 2 else []
        rows += [(conv, t, "user" if t % 2 else "assistant", f"word{t} </s> " * (t * conv % 23), 1) for t in range(1, conv % 11)]
    rows += [(99, 0, "assistant", "long " * 3000, 1), (99, 1, None, None, 1), (98, None, "user", "", 1), (98, 1, "assistant", "x", 1), (98, 1, "assistant", "x", 1)]
    rows += [(None, 0, "user", "who", 1), (None, 1, "assistant", "me", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int").repartition(5)
    windows = chat.format_windows(df, PATH, budget=120, history=40)
    want = defaultdict(list)
    for conv, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[conv].append((role, text))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    assert got == {c: brute(t) for c, t in want.items()}
    for w in windows.collect():
        assert w["n_tokens"] <= 120 or w["n_turns"] == 1
        turns = chat.read_back(w["text"])
        assert sum(t[0] for t in turns) == w["n_repeated"]
        if w["conv_id"] is not None and w["conv_id"] < 30 and w["conv_id"] % 2:
            assert turns[0][1] == "system"
        assert [chat.unescape(w["text"][s["start"]: s["end"]]) for s in w["loss"]] == [t for old, role, t in turns if role == "assistant" and not old]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_windows(df, PATH)).collect() == []


def test_a_long_system_turn_is_in_every_window():
    for tokens in (70, 110, 500):
        talk = chat._Conversation(1, 120, 40)
        rows = [r for role, text, n in [("system", "rules", tokens), *[("user", f"t{i}", 20) for i in range(12)]] for r in talk.add(role, text, n)]
        rows += list(talk.flush(True))
        read = [chat.read_back(r["text"]) for r in rows]
        assert len(rows) > 1 and all(turns[0][1:] == ("system", "rules") for turns in read)
        assert [t[2] for turns in read for t in turns if not t[0]] == ["rules", *[f"t{i}" for i in range(12)]]
        assert all(r["n_tokens"] <= 120 or r["n_turns"] == 1 and r["n_repeated"] <= 1 for r in rows)
