"""Packing of conversations, where the assistant's turns bear loss, under limits each of which binds."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from softseg.llm import packing
from softseg.llm.tokens import token_ids


@pytest.fixture(scope="module")
def talks(spark, sf):
    turn = F.struct("turn", "text", (F.col("role") == "assistant").alias("loss"))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("parts"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.transform("parts", lambda p: F.struct(p["text"].alias("text"), p["loss"].alias("loss"))).alias("parts")).repartition(3, "doc_id")


def want_of(parts):
    ids, flags = [], []
    for p in parts:
        own = np.frombuffer(token_ids(p["text"]), "<u4").tolist()
        ids += own
        flags += [bool(p["loss"])] * len(own)
    return ids + [0], flags + [bool(parts[-1]["loss"]) if parts else True]


@pytest.mark.parametrize("limits", [(1024, 256, 1024), (1024, 2, 1024), (1024, 256, 200), (512, 3, 128)])
def test_each_limit_binds_and_no_token_is_lost(talks, limits):
    tokens, segments, loss = limits
    want = {r["doc_id"]: want_of(r["parts"]) for r in talks.collect()}
    rows = packing.pack(talks, parts_col="parts", with_ids=True, tokens=tokens, segments=segments, loss=loss).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        documents[r["id"]].append(r)
        flags = want[r["id"]][1][r["start"] : r["start"] + r["length"]]
        assert r["loss_tokens"] == sum(flags) and r["doc_tokens"] == len(want[r["id"]][0])
    assert set(documents) == set(want)
    for i, pieces in documents.items():
        pieces.sort(key=lambda r: r["start"])
        assert [t for r in pieces for t in r["ids"]] == want[i][0]
    total = lambda s: (sum(r["length"] for r in s), len(s), sum(r["loss_tokens"] for r in s))
    sizes = [total(s) for s in sequences.values()]
    assert all(t <= tokens and n <= segments and x <= loss for t, n, x in sizes)
    most = [max(c) for c in zip(*sizes)]
    # The tightest limit of each setting is reached by some sequence.
    assert most[{(1024, 256, 1024): 0, (1024, 2, 1024): 1, (1024, 256, 200): 2, (512, 3, 128): 2}[limits]] == {(1024, 256, 1024): 1024, (1024, 2, 1024): 2, (1024, 256, 200): 200, (512, 3, 128): 128}[limits]


def test_odd_parts(spark):
    rows = [(1, None), (2, []), (3, [(None, True)]), (4, [("", None), ("word", None)]), (None, [("word", True)]), (5, [None])]
    docs = spark.createDataFrame(rows, "doc_id long, parts array<struct<text: string, loss: boolean>>")
    got = {r["id"]: (r["length"], r["loss_tokens"]) for r in packing.pack(docs, parts_col="parts").collect()}
    n = len(token_ids("word")) // 4
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (n + 1, 0), None: (n + 1, n + 1), 5: (1, 0)}
    assert packing.pack(docs.filter("doc_id = 9"), parts_col="parts").collect() == []
