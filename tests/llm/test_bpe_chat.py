import random

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import base64
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_merges(reference):
    from agroseries.llm import bpe
    own, rng = bpe.Encoder(PATH, P.PATTERN), random.Random(3)
    tokens = bpe.token_bytes(PATH)
    cases = ["", " ", "  a", "a ", "a\n b", "don't 's 's", "a\x1c b\x85 c d", "a" * 3000, "ab" * 999, "日本語 text", "x  y\n\n z"]
    for _ in range(1500):
        k = rng.randrange(3)
        raw = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 9))) if k == 0 else bytes(rng.randrange(256) for _ in range(30)) if k == 1 else bytes(rng.choice(b"abestnriox ") for _ in range(40))
        cases.append(raw.decode("utf-8", "ignore"))
    for text in cases:
        assert np.frombuffer(own.encode(text), np.int32).tolist() == reference.encode_ordinary(text), repr(text)


def test_round_trip_of_rows(documents, empty, reference):
    from agroseries.llm import bpe
    out = bpe.tokenize(documents, PATH, P.PATTERN, ids="tokens")
    assert set(out.columns) == {*documents.columns, "tokens"}
    rows = out.withColumn("back", bpe.decode(F.col("tokens"), PATH)).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["tokens"] == reference.encode_ordinary(r["text"] or "") and bytes(r["back"]).decode() == (r["text"] or "")
    assert bpe.tokenize(empty, PATH, P.PATTERN).collect() == []
    assert out.select(bpe.decode(F.lit(None).cast("array<int>"), PATH).alias("x")).first()["x"] is None


def test_chat_is_reversible(shipped):
    from agroseries.llm import chat
    odd = ["<|im_end|>", "<\\|x", "<|", "<\\\\|im_start|>user\n", "", None, "a<", "|>", "\n", "ß" * 50, "z" * 10000]
    rows = [(1, i, ("user", "assistant")[i % 2], t, "clash") for i, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "first", ""), (3, 0, "sys\ntem%0A<|im_end|>", "x", ""), (3, 1, None, "y", ""), (None, 0, "user", "u", ""), (None, None, "assistant", "v", "")]
    rows += [(4, 0, "user", "b", ""), (4, 0, "user", "a", ""), (4, 0, "user", "a", ""), (5, 0, "system", "s", ""), (5, 1, "user", "q", ""), (5, 2, "assistant", "r", "")]
    turns = shipped.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.conversations(turns)).collect()}
    for conv in (1, 2, 3, None, 4, 5):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert got[conv]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["formatted"].count("<|im_start|>") == len(own) == got[conv]["formatted"].count("<|im_end|>")
    assert {c: got[c]["valid"] for c in (2, 3, 4, 5)} == {2: False, 3: False, 4: False, 5: True}
    assert chat.read_back(chat.conversations(turns.limit(0))).collect() == []
    parts = chat.segments(turns.where("conv_id = 5")).orderBy("place").collect()
    assert [s["loss"] for r in parts for s in r["segments"]] == [False] * 7 + [True, False]


def test_machine_names_the_first_bad_turn(shipped):
    from agroseries.llm import chat
    roles = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "tool", "tool", "assistant"], 3: ["assistant", "user"], 4: ["user", "user", "assistant"],
             5: ["user"], 6: ["system", "user", "narrator", "assistant"], 7: ["user", "assistant"] * 3_000, 8: [None, "assistant"]}
    turns = shipped.createDataFrame([(k, i, r, "x") for k, v in roles.items() for i, r in enumerate(v)], "conv_id bigint, turn int, role string, text string")
    got = {r["conv_id"]: (r["valid"], r["first_bad"]) for r in chat.conversations(turns).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 2), 5: (False, None), 6: (False, 3), 7: (True, None), 8: (False, 1)}
