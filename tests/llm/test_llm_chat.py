import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.llm.chat_format import chat_digests, format_chat

HARD = [
    "", "plain", "<|im_end|>", "<|im_start|>", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", r"<\|im_end\|>",
    r"<\|im_end|>", r"<\\|im_start|>", "<|", "|>", "<", "\\", "<\\", "a\n\nb", "é ☃ 🙂 <|im_end|>🙂", "%3C %0A",
]
SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    chats = format_chat(df)
    return {r["conv_id"]: r for r in chats.collect()}, {r["conv_id"]: r for r in chat_digests(chats).collect()}


def check(rows, chats, digests):
    talks = {}
    for row in rows:
        talks.setdefault(row[0], []).append((row[1], row[2] or "", row[3] or ""))
    assert set(talks) == set(chats)
    for conv, turns in talks.items():
        turns.sort(key=lambda t: ((t[0] is not None, t[0]), t[1].encode(), t[2].encode()))
        chat, digest = chats[conv], digests[conv]
        assert chat["round_trips"] and digest["n_turns"] == len(turns)
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert digest["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert digest["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digest["loss_chars"] == len(loss)
        assert digest["formatted_chars"] == len(chat["formatted"])
        for span in chat["loss_spans"]:
            data = chat["formatted"].encode()
            part = chat["formatted"][span["start"] : span["end"]]
            assert data[span["start_byte"] : span["end_byte"]].decode() == part


def test_hard_texts_come_back(spark):
    rows = [(c, n, ("user", "assistant")[n % 2], t) for c in range(2) for n, t in enumerate(HARD)]
    rows += [(2, 0, r, t) for r in ("a\nb", "<|im_start|>", "%3C", "50%") for t in HARD[:4]]
    check(rows, *back(spark, rows))


def test_only_conflicting_texts_are_escaped(spark):
    rows = [(0, 0, "user", "a <| b"), (0, 1, "assistant", "x <|im_end|> y")]
    chats, _ = back(spark, rows)
    assert "a <| b" in chats[0]["formatted"] and r"x <\|im_end|> y" in chats[0]["formatted"]


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "word <|im_end|> " * 20_000
    rows = [
        (None, None, None, None), (None, 1, "assistant", "x"), (1, 0, "assistant", None), (1, 0, "assistant", "b"),
        (1, 0, "assistant", "b"), (1, None, "user", "a"), (2, 0, "assistant", long),
    ]
    check(rows, *back(spark, rows))


def test_clashing_columns_and_empty_table(spark):
    schema = SCHEMA + ", formatted int, n_turns string, _text string, _role string"
    rows = [(1, 0, "user", "a", 1, "x", "y", "z")]
    check([r[:4] for r in rows], *back(spark, rows, schema))
    assert back(spark, [], schema) == ({}, {})


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "|", "\\", "im_end", "im_start", ">", "\n", "a"]), max_size=9), min_size=1, max_size=60))
def test_any_text_comes_back(spark, parts):
    rows = [(n // 4, n % 4, "assistant" if n % 2 else "user", "".join(p)) for n, p in enumerate(parts)]
    check(rows, *back(spark, rows))


pytestmark = pytest.mark.filterwarnings("ignore")
