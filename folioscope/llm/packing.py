"""Documents into containers of fixed capacity: bulk-synchronous best fit, largest first.

Sizes are whole tokens, so documents range-sorted by size form at most ``capacity`` runs of equal
size, and containers sorted by gap form runs of equal gap. Each superstep takes the largest run of
documents that is still open, finds its successor among the gap runs (the smallest gap that holds
it), lets ranks decide which documents of the run meet which containers of the gap run, updates the
gaps, and repeats. A superstep on runs places any number of documents at once, so the steps depend
on the capacity and not on the number of documents. They yield rank intervals; documents are ranked
within their size in parallel and look up their place there.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.runtime import spread, written

#: Documents of one size are ranked in so many independent parts.
SHARDS = 512

#: Fixed value: the split pattern of the public byte-level tokenizers.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoder(path: str) -> Callable[[str], list[int]]:
    """Encoder of a vocabulary file with one base64 token and its rank per line."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(texts: pd.Series, encode: Callable[[str], list[int]]) -> list[int]:
    """Tokens of each whole text; null is 0. The encoder takes about linear time, on long runs without white space as well."""
    return [0 if t is None else len(encode(t)) for t in texts]


def sized(df: DataFrame, ident: str, text: str, vocabulary: str) -> DataFrame:
    """``(ident, tokens)``. The vocabulary file must be readable at the same path on every host."""
    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_encoder(vocabulary)
        for batch in batches:
            yield pd.Series(token_counts(batch, encode), dtype="int64")

    return spread(df.select(ident, text)).select(ident, tokens(text).alias("tokens"))


@dataclass
class _Run:
    """Containers ``first .. first + count - 1`` with the same ``fill`` and number of ``items``."""

    first: int
    count: int
    fill: int
    items: int


#: size, first rank, documents, first container, documents per container, tokens and items already there
Placement = tuple[int, int, int, int, int, int, int]


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Best fit, largest first, for ``sizes`` (size to number of items), and the containers used.

    The same containers come out as if items were placed one by one, each into the fullest
    container that holds it.
    """
    gaps: list[int] = []
    runs: dict[int, list[_Run]] = {}
    placements: list[Placement] = []
    used = 0

    def keep(run: _Run) -> None:
        gap = capacity - run.fill
        if run.count and gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append(run)

    for size in sorted(sizes, reverse=True):
        rank, open_items = 0, sizes[size]
        while open_items:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                run = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
                each = gap // size
            else:
                each = capacity // size
                run = _Run(used, -(-open_items // each), 0, 0)
                used += run.count
            full = min(run.count, open_items // each)
            if full:
                placements.append((size, rank, full * each, run.first, each, run.fill, run.items))
                rank, open_items = rank + full * each, open_items - full * each
            rest = _Run(run.first + full, run.count - full, run.fill, run.items)
            if open_items and rest.count:
                placements.append((size, rank, open_items, rest.first, open_items, run.fill, run.items))
                keep(_Run(rest.first, 1, run.fill + open_items * size, run.items + open_items))
                rest = _Run(rest.first + 1, rest.count - 1, run.fill, run.items)
                open_items = 0
            keep(_Run(run.first, full, run.fill + each * size, run.items + each))
            keep(rest)
    return placements, used


def _ranked(items: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``: the number of each item among those of its size, from 0, without one task per size."""
    parts = items.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(SHARDS)).cast("int"))
    before = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("size", "shard").agg(F.count(F.lit(1)).alias("n")).select("size", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("size", "shard").orderBy(*order)
    return parts.withColumn("_r", F.row_number().over(inside) - 1).join(counts, ["size", "shard"]).withColumn("rank", F.col("_r") + F.col("ahead")).drop("_r", "ahead", "shard")


def pack(df: DataFrame, ident: str, text: str, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """One row per body or piece: its container, place and token range.

    Columns: ``ident``, ``piece`` (0 for a whole body), ``first_token`` (of the piece in its body),
    ``tokens``, ``container``, ``position`` (of the item in its container, from 0) and ``offset``
    (its first token there). Only a body above ``capacity`` is split, into full pieces and a rest.
    Empty and null bodies have no tokens and need no room: their container, position and offset are
    null. Ids should be unique; repeated rows are packed as often as they come, each time in a place
    of its own. The only thing that reaches the driver is the number of items of each size, at most
    ``capacity`` rows; the plan sent to the tasks has some thousand intervals at any size of input.
    """
    once = written(sized(df, ident, text, vocabulary), "sizes")
    whole = once.where("tokens > 0").withColumn("copy", F.monotonically_increasing_id())
    cut = F.sequence(F.lit(0).cast("bigint"), ((F.col("tokens") - 1) / capacity).cast("bigint"))
    pieces = whole.select(ident, "copy", "tokens", F.explode(cut).alias("piece")).select(
        ident, "copy", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("size"),
    )
    items = written(pieces, "pieces")
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements, _ = plan(histogram, capacity)
    table = np.array(sorted(placements), np.int64).reshape(-1, 7)
    starts = table[:, 0] * (1 << 50) + table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, rank = b["size"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            p = table[np.searchsorted(starts, size * (1 << 50) + rank, "right") - 1]
            inside = rank - p[:, 1]
            nth = inside % p[:, 4]
            yield pd.DataFrame({ident: b[ident], "piece": b["piece"], "first_token": b["first_token"], "tokens": size, "container": p[:, 3] + inside // p[:, 4], "position": p[:, 6] + nth, "offset": p[:, 5] + nth * size})

    kind = once.schema[ident].dataType.simpleString()
    layout = f"`{ident}` {kind}, piece int, first_token bigint, tokens bigint, container bigint, position bigint, offset bigint"
    placed = _ranked(items, [ident, "copy", "piece"]).select(ident, "piece", "first_token", "size", "rank").mapInPandas(place, layout)
    empty = once.where("tokens = 0").select(ident, F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), "tokens", *[F.lit(None).cast("bigint").alias(c) for c in ("container", "position", "offset")])
    return placed.unionByName(empty)


def faults(packed: DataFrame, ident: str, capacity: int) -> DataFrame:
    """One row of counts over the rows of :func:`pack`, all zero but the first: ids, containers that are
    too full, items that do not begin where the one before ends, and ids that are split though they fit, or into pieces that are not
    full, or whose pieces leave out or repeat tokens. Ids must be unique in the packed table."""
    number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    full = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("used"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("places"), F.count_distinct("offset").alias("starts"))
    rooms = full.agg(number(F.col("used") > capacity).alias("n_too_full"), number((F.col("used") != F.col("end")) | (F.col("last") + 1 != F.col("n")) | (F.col("places") != F.col("n")) | (F.col("starts") != F.col("n"))).alias("n_gaps"))
    own = packed.groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count_distinct("piece").alias("pieces"), F.sum(F.when(F.col("tokens") == capacity, 1).otherwise(0)).alias("full"), F.min(F.col("first_token") == F.col("piece") * capacity).alias("in_place"))
    wrong = (F.col("all") != F.col("end")) | (F.col("pieces") != F.col("n")) | ~F.col("in_place") | (F.col("full") < F.col("n") - 1) | ((F.col("n") > 1) & (F.col("all") <= capacity))
    ids = own.agg(F.count(F.lit(1)).alias("n_ids"), number(wrong).alias("n_badly_split"))
    return ids.join(rooms, F.lit(True)).select("n_ids", "n_too_full", "n_gaps", "n_badly_split")  # one row each
