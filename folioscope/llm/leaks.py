"""Evaluation items inside a corpus: prefix-filtered set join on word shingles.

Every item has two units, its passage and its question, each a set of five-word shingles (a unit of
fewer words is one shingle of all its words). Shingles that several items share say nothing about an
item and are left out of a passage, unless it has no others. A document holds a unit if it contains
a given share of the unit's shingles. Of the shingles ordered from rare to frequent in the corpus,
such a document must contain one of the first ``n - ceil(share * n) + 1``; only documents that do are
joined with the rest. Length and position bound them next, and the share is then measured exactly,
over windows of the item's size.

The texts are read once, whatever the number of items: a Bloom filter of all shingles wanted goes with
the tasks, and what passes it is joined by a hash of 128 bits.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from folioscope.runtime import spread, written

WORDS = 5
#: Share of a unit's shingles from which it counts as contained. One changed word spoils five
#: shingles, so a third of a passage with every eighth word changed keeps about a fifth of them.
PASSAGE_SHARE, QUESTION_SHARE = 0.2, 0.8
#: A stretch counts from so many shingles in an item-sized window, so stray phrases do not add up.
STRETCH = 3
#: The filter has this many bits for a shingle, up to 64 MB; with more shingles it passes more, which the join then drops.
BITS, MOST_BITS = 64, 1 << 29
#: Characters that are taken together, and words whose hashes a worker keeps.
CHUNK, CACHE = 4_000_000, 1_000_000

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_MARKED = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_LATIN_MARK = re.compile("[̀-ͯ]")
_BEYOND = re.compile("[֐-\U0010ffff]")
_IDEOGRAPH = re.compile("([぀-ヿ㐀-䶿一-鿿豈-﫿])")
#: Bytes by the characters they appear as where UTF-8 was read as a Western single-byte encoding.
_AS_BYTE = {bytes([b]).decode(e): b for e in ("latin-1", "cp1252") for b in range(0x80, 0x100) if bytes([b]).decode(e, "ignore")}
_TRAIL = "[" + "".join(c for c, b in _AS_BYTE.items() if b < 0xC0) + "]"
_DAMAGED = re.compile(f"(?:[\xc2-\xdf]{_TRAIL}|[\xe0-\xef]{_TRAIL}{{2}}|[\xf0-\xf4]{_TRAIL}{{3}})+")


def _repaired(m: re.Match) -> str:
    """A damaged stretch as it was. One character alone is repaired only from leads that end no word of sound text."""
    try:
        found = bytes(_AS_BYTE[c] for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]
    return found if len(found) > 1 or m[0][0] in "\xc2\xc3\xc4\xc5\xe2\xf0" else m[0]


def words(text: str) -> list[str]:
    """Lower-case words without markup, in any script; an ideograph is a word.

    UTF-8 that was read as a single-byte encoding is repaired, and Latin letters lose their accents, so that
    differently encoded or typed forms of a word agree.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = _LATIN_MARK.sub("", unicodedata.normalize("NFKD", _DAMAGED.sub(_repaired, text)))
    if not _BEYOND.search(text):
        return _WORD.findall(text.casefold())
    return _MARKED.findall(_IDEOGRAPH.sub(r" \1 ", unicodedata.normalize("NFC", text).casefold()))


class _Vocabulary(dict):
    """Numbers of words, and two independent hashes of each."""

    def __init__(self) -> None:
        super().__init__()
        self.low: list[int] = []
        self.high: list[int] = []

    def __missing__(self, word: str) -> int:
        both = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"))
        self.low.append(both & (1 << 64) - 1), self.high.append(both >> 64)
        self[word] = number = len(self.low)
        return number

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([0, *self.low], np.uint64), np.array([0, *self.high], np.uint64)


def _mixed(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(starts), width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles(texts: list[list[str]], widths: list[int], vocabulary: _Vocabulary, chosen=lambda h: slice(None)) -> pd.DataFrame:
    """``text`` (its number), ``pos``, ``h`` and ``check`` of the word runs of each of ``widths``; ``chosen`` picks some by ``h``."""
    ids = np.fromiter((vocabulary[w] for t in texts for w in t), np.int64, sum(map(len, texts)))
    low, high = vocabulary.hashes()
    low, high = low[ids], high[ids]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = []
    for width in widths:
        starts = np.arange(len(ids))
        starts = starts[starts + width <= ends[owner]]
        h = _mixed(low, starts, width)
        at = chosen(h)
        starts, h = starts[at], h[at]
        text = owner[starts]
        out.append(pd.DataFrame({"text": text, "pos": (starts - (ends - sizes)[text]).astype(np.int32), "h": h.view(np.int64), "check": _mixed(high, starts, width).view(np.int64)}))
    return pd.concat(out, ignore_index=True)


def _units(items: DataFrame, item: str, passage: str, question: str) -> DataFrame:
    """``(unit, item, part, size, width, n, needed, h, check)``: the shingles that count for each unit."""
    kind = items.schema[item].dataType.simpleString()
    given = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("text")) for p, c in (("passage", passage), ("question", question))])).alias("u"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _Vocabulary()
        for f in frames:
            texts = [words(t) for t in f["text"]]
            for width in range(1, WORDS + 1):
                at = np.array([i for i, t in enumerate(texts) if min(len(t), WORDS) == width], np.int64)
                if len(at):
                    own = shingles([texts[i] for i in at], [width], vocabulary).drop_duplicates(["text", "h", "check"])
                    row = at[own["text"]]
                    yield pd.DataFrame({"unit": f["unit"].to_numpy()[row], "item": f["item"].to_numpy()[row], "part": f["part"].to_numpy()[row], "size": [len(texts[i]) for i in row], "width": width, "h": own["h"].to_numpy(), "check": own["check"].to_numpy()})

    numbered = given.select("item", "u.*").where("text IS NOT NULL").distinct().withColumn("unit", F.xxhash64("item", "part", "text"))
    every = written(numbered.mapInPandas(split, f"unit bigint, item {kind}, part string, size int, width int, h bigint, check bigint"), "unit-shingles")
    shared = every.where("part = 'passage'").groupBy("h", "check").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi").select("h", "check", F.lit(True).alias("is_shared"))
    # A question must be there as a whole, so all its shingles count.
    marked = every.join(shared, ["h", "check"], "left").withColumn("own", F.col("is_shared").isNull() | (F.col("part") == "question"))
    counts = marked.groupBy("unit").agg(F.count_if("own").alias("n_own"), F.count(F.lit(1)).alias("n_all"))
    share = F.when(F.col("part") == "passage", PASSAGE_SHARE).otherwise(QUESTION_SHARE)
    n = F.when(F.col("n_own") > 0, F.col("n_own")).otherwise(F.col("n_all"))
    kept = marked.join(counts, "unit").where("own OR n_own = 0").withColumn("n", n.cast("int"))
    return kept.select("unit", "item", "part", "size", "width", "n", F.greatest(F.lit(1), F.ceil(share * F.col("n") - 1e-9)).cast("int").alias("needed"), "h", "check")


def _filter(units: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of a Bloom filter of all ``n`` shingles of ``units``; what reaches the driver is bounded by its size."""
    bits = min(MOST_BITS, 1 << max(10, (BITS * n - 1).bit_length()))
    places = units.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")).select(F.col("p").bitwiseAND(bits - 1).alias("p"))
    masks = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("mask")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[masks["at"].to_numpy(np.int64)] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    return table, bits


def _hits(docs: DataFrame, doc: str, text: str, table: np.ndarray, bits: int, widths: list[int]) -> DataFrame:
    """``(doc, pos, h, check)``: word runs of every text that pass the filter."""
    low, six = np.uint64(bits - 1), np.uint64(63)

    def chosen(h: np.ndarray) -> np.ndarray:
        at = np.arange(len(h))
        for p in (np.uint64(0), np.uint64(32)):
            place = (h[at] >> p) & low
            at = at[(table[place >> np.uint64(6)] >> (place & six)) & np.uint64(1) == 1]
        return at

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _Vocabulary()
        for f in frames:
            lengths = f[text].str.len().cumsum()
            for _, part in f.groupby(lengths // CHUNK, sort=False):
                if len(vocabulary) > CACHE:
                    vocabulary = _Vocabulary()
                hits = shingles([words(t) for t in part[text]], widths, vocabulary, chosen)
                if len(hits):
                    yield hits.assign(**{doc: part[doc].to_numpy()[hits["text"]]})[[doc, "pos", "h", "check"]]

    known = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, text)
    return written(spread(known).mapInPandas(find, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, pos int, h bigint, check bigint"), "shingle-hits")


def prefixes(units: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(unit, h, check)``: the necessary prefix of each unit, rarest first; ``frequency``: (h, check, freq)."""
    rarest = Window.partitionBy("unit").orderBy(F.coalesce("freq", F.lit(0)), "h", "check")
    ranked = units.join(frequency, ["h", "check"], "left").withColumn("rank", F.row_number().over(rarest))
    return ranked.where(F.col("rank") <= F.col("n") - F.col("needed") + 1).select("unit", "h", "check")


def _contained(shingle: np.ndarray, positions: np.ndarray, size: int, n: int, needed: int) -> float:
    """Share of the unit's shingles in stretches of at least ``STRETCH`` shingles per item-sized window."""
    pairs = np.unique(np.stack([positions.astype(np.int64), shingle]), axis=1)  # a repeated row counts once
    p, s = pairs[0], pairs[1]
    in_window = np.searchsorted(p, p + size, "left") - np.searchsorted(p, p - size, "right")
    return len(np.unique(s[in_window >= min(STRETCH, needed)])) / n


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", question: str = "question") -> DataFrame:
    """``(doc, item, part, share)`` for every document that holds an item's passage or question.

    Null and empty texts, passages and questions contain nothing and are contained nowhere; rows
    with a null id are left out. A unit of fewer than five words is held where all its words follow each
    other. Rows that repeat a document or an item do not change the result. Empty tables give no rows.
    """
    doc_kind, item_kind = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    counted = Observation()
    by_width = [F.count_if(F.col("width") == w).alias(str(w)) for w in range(1, WORDS + 1)]
    units = written(_units(items, item, passage, question).observe(counted, *by_width), "wanted")
    sizes = {int(w): n for w, n in counted.get.items() if n}
    widths = sorted(sizes)
    if not widths:
        return docs.sparkSession.createDataFrame([], f"`{doc}` {doc_kind}, item {item_kind}, part string, share double")
    hits = _hits(docs, doc, text, *_filter(units, sum(sizes.values())), widths).withColumnRenamed(doc, "_doc")
    frequency = hits.groupBy("h", "check").agg(F.count(F.lit(1)).alias("freq"))
    first = prefixes(units, frequency)
    candidates = hits.select("_doc", "h", "check").join(first, ["h", "check"]).select("_doc", "unit").distinct()
    gathered = (
        hits.join(units, ["h", "check"])
        .join(candidates, ["_doc", "unit"], "left_semi")
        .groupBy("_doc", "unit", "item", "part", "size", "n", "needed")
        .agg(F.collect_list(F.struct("h", "pos")).alias("hits"))
        .where(F.size(F.array_distinct(F.col("hits.h"))) >= F.col("needed"))  # length bound
    )

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            share = [_contained(np.asarray(h), np.asarray(p), *rest) for h, p, *rest in zip(f["hs"], f["at"], f["size"], f["n"], f["needed"], strict=True)]
            least = f["part"].map({"passage": PASSAGE_SHARE, "question": QUESTION_SHARE}).to_numpy(np.float64)
            out = f[["_doc", "item", "part"]].assign(share=np.array(share, np.float64)).rename(columns={"_doc": doc})
            yield out[out["share"].to_numpy() >= least]

    return gathered.select("_doc", "item", "part", "size", "n", "needed", F.col("hits.h").alias("hs"), F.col("hits.pos").alias("at")).mapInPandas(verify, f"`{doc}` {doc_kind}, item {item_kind}, part string, share double")
