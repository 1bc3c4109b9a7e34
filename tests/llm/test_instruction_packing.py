"""Conversations under three limits at once: none is broken, every conversation is there whole, and the dot product decides."""

from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

SF = "/root/testdata/sf0.01"


def test_conversations_keep_all_limits(spark):
    real = Tokenizer.from_file(queries.tokenizer_path())
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        n = len(real.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.conv_id][0] += n
        want[r.conv_id][1] += n * (r.role == "assistant")
    rows = queries.instruction_packing(spark, SF).collect()
    assert {r.example_id: [r.n_tokens, r.n_loss] for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.n_tokens for r in own[:-1])]).tolist()
        assert len(own) == 1 or (sum(r.n_tokens for r in own) <= 4096 and sum(r.n_loss for r in own) <= 2048 and len(own) <= 16)
    least = max(sum(n for n, _ in want.values()) / 4096, sum(x for _, x in want.values()) / 2048)
    assert len(bins) <= 1.35 * least + 1


def test_the_dot_product_decides():
    """Room for loss is scarce after the first: a longer example that bears much is passed over for one that bears none."""
    n, loss = np.array([60, 30, 29]), np.array([60, 30, 0])
    placed, _, _ = packing.pack_block(packing.Items(np.arange(3), np.zeros(3, int), n, loss), packing.Limits(128, 8, 80), False, True, 0)
    first = {r[0] for r in placed.rows if r[3] == placed.rows[0][3]}
    assert first == {0, 2}


def test_odd_conversations(spark):
    rows = [(1, "user", None, 5), (1, None, "a b", 5), (None, "assistant", "", 5), (2, "assistant", "x", 5)]
    df = spark.createDataFrame(rows, "conv_id long, role string, text string, n int")
    got = {r.example_id: (r.n_tokens, r.n_loss) for r in packing.instruction_examples(df, queries.tokenizer_path()).collect()}
    assert got == {1: (4, 0), None: (1, 1), 2: (2, 2)}
    assert packing.pack_examples(packing.instruction_examples(df.limit(0), queries.tokenizer_path())).count() == 0
