import random
import time
from collections import Counter

import pandas as pd
import pytest

from folioscope.llm import packing
from folioscope.llm.queries import VOCABULARY


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(capacity - s)
    return Counter(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.randint(4, 60)
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    placements, used = packing.plan(Counter(sizes), capacity)
    seen, held = set(), {}
    for size, rank, n, first, each, fill, items in placements:
        for k in range(n):
            assert (size, rank + k) not in seen
            seen.add((size, rank + k))
            held.setdefault(first + k // each, []).append((fill + k % each * size, size, items + k % each))
    assert len(seen) == len(sizes) and used == len(held)
    fills = []
    for own in held.values():
        at = 0
        for nth, (offset, size, position) in enumerate(sorted(own)):
            assert (offset, position) == (at, nth)
            at += size
        fills.append(capacity - at)
    assert Counter(fills) == best_fit(sizes, capacity)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARDS", 3)
    texts = ["", None, "one", "one", "a b c d e f", " ".join(["word"] * 500), "x" * 3000, "é ü\n\n  end"]
    df = spark.createDataFrame([(i % 7, t, 1, 2) for i, t in enumerate(texts * 5)], "doc_id bigint, text string, size int, rank int")
    rows = packing.pack(df, "doc_id", "text", VOCABULARY, capacity=64).toPandas()
    assert len(rows[rows.tokens == 0]) == 10 and rows[rows.tokens == 0].container.isna().all()
    held = rows[rows.tokens > 0].sort_values(["container", "position"])
    total = held.groupby("container").tokens.sum()
    assert total.max() <= 64
    assert (held.groupby("container").tokens.cumsum() - held.tokens == held.offset).all()
    assert (held.groupby("container").cumcount() == held.position).all()
    encode = packing.load_encoder(VOCABULARY)
    assert held.tokens.sum() == sum(len(encode(t)) for t in texts * 5 if t)
    split = held[held.piece > 0]
    assert (split.first_token == split.piece * 64).all()


def test_long_texts_are_counted_whole():
    encode = packing.load_encoder(VOCABULARY)
    texts = ["word and  more\t\n text, " * 3000, "z" * 500 + "   b" * 90, "ab3" * 20_000, "QUJDREVGR0g" * 9_000, "q" * 300_000, " " * 300_000, "é" * 100_000]
    began = time.perf_counter()
    assert packing.token_counts(pd.Series([*texts, None, ""]), encode) == [len(encode(t)) for t in texts] + [0, 0]
    assert time.perf_counter() - began < 20


def test_faults_are_seen(spark):
    good = [(1, 0, 0, 10, 0, 0, 0), (1, 1, 10, 4, 1, 0, 0), (2, 0, 0, 6, 1, 1, 4), (3, 0, 0, 0, None, None, None)]
    layout = "doc_id bigint, piece int, first_token bigint, tokens bigint, container bigint, position bigint, offset bigint"
    count = lambda rows: tuple(packing.faults(spark.createDataFrame(rows, layout), "doc_id", 10).first())
    assert count(good) == (3, 0, 0, 0)
    assert count([*good, (4, 0, 0, 1, 1, 2, 10)]) == (4, 1, 0, 0)
    assert count([*good[:2], (2, 0, 0, 6, 1, 1, 3), good[3]]) == (3, 0, 1, 0)
    assert count([(1, 0, 0, 9, 0, 0, 0), *good[1:]]) == (3, 0, 0, 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(df, "doc_id", "text", VOCABULARY).count() == 0
