"""Chat digests against a plain formatter, many conversations, ids that doubles cannot hold beside nulls."""

import hashlib
import random

import pytest

pytest.importorskip("motionlake.llm")

from motionlake.llm import chat, queries  # noqa: E402


def plain(rows):
    """What op3 must give, from the rows alone; the length of the output from the written template."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = sum(len(f"<|role:{chat.escape(r)}|>{chat.escape(t)}<|end|>") for _, r, t in turns)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), digest(told), len(loss), digest(loss), chars)
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_digests(spark, parts):
    rng = random.Random(parts)
    big = 9007199254740992
    alphabet = [*"ab ␛01<>[/]|\n\té😀", *chat.CONTROL]
    convs = [None, 1, 2, big, big + 1, big + 2, big + 3, -big - 1]
    rows = []
    for k in range(400):
        text = None if rng.random() < 0.1 else "".join(rng.choices(alphabet, k=rng.randrange(12)))
        turn = None if rng.random() < 0.05 else big + k
        rows.append((rng.choice(convs), turn, rng.choice(["user", "assistant", "system", "tool", None, "<|end|>"]), text))
    rows += [rows[5], rows[5], (7, 0, "assistant", "long " * 40000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(parts)
    path = queries.chat_tokenizer()
    got = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(chat.format_turns(df, path), path).collect()}
    assert got == plain(rows)


def test_string_and_mixed_ids(spark):
    rows = [("b", 2, "user", "x"), (None, 1, "assistant", "y"), ("b", 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    path = queries.chat_tokenizer()
    got = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(chat.format_turns(df, path), path).collect()}
    assert got == plain(rows)
