"""Abusive, hateful or sexual content by compression distance.

Two zstandard dictionaries are fitted, one on ordinary and one on abusive text. A window of a text
that shares its wording with one of them compresses shorter with that one; a document scores the
largest advantage of the abusive dictionary over its windows, and a threshold is calibrated on
labelled documents, each scored by a model that it took no part in. Disguised writing (look-alike letters, digits for
letters, spread or repeated letters, symbols inside words) is undone first.

The dictionaries hold the training windows themselves, those that occur repeatedly or add wording
that is not there yet, the most frequent nearest to the end where matches are cheapest. The trainer that comes
with zstandard keeps only the most repeated fragments and misses rare wordings; ``trained=True`` uses it, and
``python -m folioscope.llm.compare_dictionaries`` compares both (see the README).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.runtime import spread, written

#: The fit takes a sample of the labelled documents: of each class about so many documents, and so many characters, at most.
FIT_DOCUMENTS, FIT_CHARACTERS = 12_000, 16_000_000
#: Sizes of the dictionaries.
ORDINARY_BYTES, ABUSIVE_BYTES = 1_000_000, 250_000
LEVEL = 12
#: Words in a window and from one window to the next; shorter sentences are one window.
WINDOW, STEP = 9, 3
#: Score of a document without any word.
LOWEST = -10.0
#: Log-odds from which a window counts as abusive wording, and up to which as ordinary wording.
ABUSIVE_ODDS, ORDINARY_ODDS = 1.2, 0.7
CACHE = 200_000

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏοαεικνρτυωкмтвнɡı", "aeopcyxijsdhloaeikvptuwkmtbhgi")
STAND_INS = str.maketrans("013457@$", "oieastas")

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPREAD = re.compile(r"(?<![^\W_])(?:[^\W_][ *_\-·•#+~|.]){3,}[^\W_](?![^\W_])")
#: Inner letters that every match of ``_SPREAD`` has; cheaper to search for.
_SPREAD_INNER = re.compile(r"[ *_\-·•#+~|.][^\W_][ *_\-·•#+~|.][^\W_][ *_\-·•#+~|.]")
#: Characters that may hide or make a sign between spread letters.
_BEYOND_PIECES = re.compile("[^\x00-\x7f\xa1-\u1fff\u2010-\u2027\u2030-\u205e\u2070-\u2fff\u3001-\ufdff]")
_SPREAD_SIGN = re.compile(r"[ *_\-·•#+~|.]")
_SIGN = re.compile(r"[\d@$]")
_TOKEN = re.compile(r"[\w@$]*[\d@$][\w@$]*")
INSERTED = "*_-·•#+~|."
_INSIDE = re.compile(r"(?<=[^\W\d_])[*_\-·•#+~|.](?=[^\W\d_])")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[.!?…])\s+|\n+|</?[A-Za-z!][^<>]*>")


def plain(text: str) -> str:
    """Lower-case text with disguises undone; numbers become 0."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(LOOKALIKES)
    else:
        text = text.lower()
    if _SPREAD_INNER.search(text):
        text = _SPREAD.sub(lambda m: _SPREAD_SIGN.sub("", m[0]), text)
    signed = _SIGN.search(text) is not None
    if signed:
        text = _TOKEN.sub(lambda m: m[0].translate(STAND_INS) if any(c.isalpha() for c in m[0]) else m[0], text)
    if any(c in text for c in INSERTED):
        text = _INSIDE.sub("", text)
    if any(c * 3 in text for c in set(text)):
        text = _REPEATED.sub(r"\1", text)
    return _NUMBER.sub("0", text) if signed else text


class _Pieces(dict):
    """Words of the pieces of text between blanks, which recur; each is made plain once."""

    def __missing__(self, piece: str) -> str:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = words = " ".join(_WORD.findall(plain(piece)))
        return words


_PIECES = _Pieces()


def _words(sentence: str) -> list[str]:
    """Words of ``plain(sentence)``. Only spread letters and invisible characters reach beyond a piece between blanks."""
    if _SPREAD_INNER.search(sentence) or (not sentence.isascii() and _BEYOND_PIECES.search(sentence)):
        return _WORD.findall(plain(sentence))
    return " ".join(map(_PIECES.__getitem__, sentence.split())).split()


def sentence_windows(sentence: str) -> list[str]:
    """The sentence as one window, or overlapping runs of its words if it is long."""
    found = _words(sentence) if sentence else []
    if len(found) <= WINDOW + STEP:
        return [" ".join(found)] if found else []
    starts = [*range(0, len(found) - WINDOW, STEP), len(found) - WINDOW]
    return [" ".join(found[i : i + WINDOW]) for i in starts]


def windows(text: str | None) -> list[str]:
    """Windows over the whole text, sentence by sentence."""
    return [w for sentence in _BREAK.split(text or "") for w in sentence_windows(sentence)]


def _pairs(window: str) -> set[str]:
    w = window.split(" ")
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w)


def _content(found: Iterable[str], counts: Counter[str], size: int) -> bytes:
    """The most frequent windows that fit into ``size`` bytes; equally frequent ones in order of a hash."""
    seen: set[tuple[str, ...]] = set()
    kept, used = [], 0
    for window in sorted(found, key=lambda w: (-counts[w], md5(w.encode("utf-8", "replace")).digest(), w)):
        w = window.split(" ")
        runs = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        if counts[window] > 1 or 3 * len(runs - seen) >= len(runs):
            encoded = window.encode()
            used += len(encoded) + 1
            if used > size:
                break
            kept.append(encoded)
            seen |= runs
    return b" ".join(reversed(kept))


def _trained(found: Iterable[str], counts: Counter[str], size: int) -> bytes:
    """The dictionary that zstandard's own trainer makes of the windows; empty where they are too few for it."""
    samples = [w.encode("utf-8", "replace") for w in sorted(found) for _ in range(counts[w])]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


@dataclass(frozen=True)
class AbuseModel:
    """Both dictionaries and the threshold. Without either dictionary nothing is flagged."""

    ordinary: bytes
    abusive: bytes
    threshold: float = math.inf
    trained: bool = False

    @classmethod
    def fit(cls, ordinary: list[list[str]], abusive: list[list[str]], trained: bool = False) -> AbuseModel:
        """From the windows of documents labelled ordinary and abusive.

        Labels belong to documents and some are wrong, so windows are told apart by how much more
        often their word pairs occur in documents of one class. Shares of documents are compared, both
        smoothed by the same share, so a larger class at equal shares changes nothing.
        """
        pairs = [Counter(p for doc in docs for p in set().union(*map(_pairs, doc))) for docs in (ordinary, abusive)]
        counts = [Counter(w for doc in docs for w in doc) for docs in (ordinary, abusive)]
        n = [max(1, len(ordinary)), max(1, len(abusive))]
        least = 0.2 / min(n)

        def odds(window: str) -> float:
            own = _pairs(window)
            return sum(math.log(pairs[1][p] / n[1] + least) - math.log(pairs[0][p] / n[0] + least) for p in own) / len(own)

        known = {w: odds(w) for w in (counts[0].keys() | counts[1].keys())}
        make = _trained if trained else _content
        return cls(
            make((w for w in counts[0] if known[w] < ORDINARY_ODDS), counts[0], ORDINARY_BYTES),
            make((w for w in counts[1] if known[w] > ABUSIVE_ODDS), counts[1], ABUSIVE_BYTES),
            trained=trained,
        )

    @property
    def usable(self) -> bool:
        return len(self.ordinary) >= 8 and len(self.abusive) >= 8

    def scorer(self) -> Callable[[str | None], float]:
        """Score of a text: ten times the bytes saved per character, at the window where most are saved."""
        def lengths(content: bytes) -> Callable[[bytes], int]:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO if self.trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            return lambda data: len(c.compress(data))

        if not self.usable:
            return lambda text: LOWEST
        with_ordinary, with_abusive = lengths(self.ordinary), lengths(self.abusive)
        known: dict[str, float] = {}
        windows_known: dict[str, float] = {}

        def saved(window: str) -> float:
            score = windows_known.get(window)
            if score is None:
                if len(windows_known) >= CACHE:
                    windows_known.clear()
                data = window.encode("utf-8", "replace")
                score = windows_known[window] = (with_ordinary(data) - with_abusive(data)) / (len(window) + 12) * 10
            return score

        def of(sentence: str) -> float:
            score = known.get(sentence)
            if score is None:
                if len(known) >= CACHE:
                    known.clear()
                score = known[sentence] = max(map(saved, sentence_windows(sentence)), default=LOWEST)
            return score

        return lambda text: max(map(of, _BREAK.split(text)), default=LOWEST) if text else LOWEST


def _scored(df: DataFrame, models: dict[int, AbuseModel], text: str, keep: list[str], by: str | None = None) -> DataFrame:
    """``keep`` and ``score``, by the model that the column ``by`` names."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {k: m.scorer() for k, m in models.items()}
        for b in batches:
            found = b[text].map(of[0]) if by is None else pd.Series([of[k](t) for k, t in zip(b[by], b[text], strict=True)], b.index, "float64")
            yield b[keep].assign(score=found.astype("float64"))

    layout = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*dict.fromkeys([*keep, *([by] if by else []), text]))).mapInPandas(score, f"{layout}, score double")


def threshold(histogram: list[tuple[float, int, int]]) -> float:
    """Middle of the scores at which F1 is within a hundredth of its best; ``histogram``: (score, label, n)."""
    positives = sum(n for _, label, n in histogram if label)
    if not positives:
        return math.inf
    at = Counter()
    for score, label, n in histogram:
        at[score, label] += n
    flagged = hits = 0
    curve = []
    for score in sorted({s for s, _, _ in histogram}, reverse=True):
        hits += at[score, 1]
        flagged += at[score, 0] + at[score, 1]
        curve.append((2 * hits / (flagged + positives), score))
    best = max(f for f, _ in curve)
    good = [s for f, s in curve if f >= best - 0.01]
    below = [s for _, s in curve if s < min(good)]
    return (max(good) + max(below, default=min(good))) / 2


def labelled(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str) -> tuple[DataFrame, dict]:
    """The labelled documents, written once, with a ``fold`` of two and a ``lot``, and the size of each class and fold.

    ``yes`` of ``all`` labels call a document abusive. Null labels, and labels of unknown documents, are ignored.
    """
    counted = Observation()
    rows = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(ident).agg(F.sum(F.when(F.col(label) != 0, 1).otherwise(0)).alias("yes"), F.count(F.lit(1)).alias("all"))
    place = F.xxhash64(ident)
    kind = F.when(F.col("yes") == 0, 0).when(F.col("yes") == F.col("all"), 1)
    known = docs.select(ident, F.col(text).alias("text")).join(rows, ident).select("text", "yes", "all", kind.alias("kind"), F.pmod(place, F.lit(2)).cast("int").alias("fold"), F.pmod(F.shiftright(place, 8), F.lit(1 << 20)).alias("lot"))
    of = lambda f, k: (F.col("fold") == f) & (F.col("kind") == k)
    sizes = [F.sum(F.when(of(f, k), v).otherwise(0)).alias(f"{n}{f}{k}") for f in (0, 1) for k in (0, 1) for n, v in (("n", F.lit(1)), ("c", F.coalesce(F.length("text"), F.lit(0))))]
    once = written(known.observe(counted, *sizes), "labelled")
    return once, {k: v or 0 for k, v in counted.get.items()}


#: Numbers of the models: of each fold, and of both.
BOTH = 2


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "abusive", trained: bool = False) -> AbuseModel:
    """Fit on the labelled documents (a sample bounded by ``FIT_DOCUMENTS`` and ``FIT_CHARACTERS``), calibrate on all of them.

    Labelled documents are parted in two folds. A model of each fold scores all documents of the other,
    and these scores set the threshold of the model of both folds. Documents whose labels contradict
    each other are left out of the fit; for calibration each of their labels counts. The models are
    made in the tasks; only dictionaries and a histogram of scores reach the driver.
    """
    known, sizes = labelled(docs, labels, ident, text, label)
    return calibrated(known, sizes, trained)[0]


def calibrated(known: DataFrame, sizes: dict, trained: bool = False) -> tuple[AbuseModel, list[tuple[float, int, int, int]]]:
    """The model of all ``known`` documents, and the (score, label, fold, n) that its threshold comes from."""
    def share(model: int, kind: int) -> float:
        folds = (0, 1) if model == BOTH else (model,)
        n, c = (sum(sizes.get(f"{what}{f}{kind}", 0) for f in folds) for what in "nc")
        return min(1.0, FIT_DOCUMENTS / max(n, 1), FIT_CHARACTERS / max(c, 1))

    drawn = F.lit(False)
    for m in (0, 1, BOTH):
        for k in (0, 1):
            drawn = drawn | ((F.col("model") == m) & (F.col("kind") == k) & (F.col("lot") < int(share(m, k) * (1 << 20))))

    def make(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [[windows(t) for t in rows["text"][rows["kind"] == k]] for k in (0, 1)]
        made = AbuseModel.fit(*found, trained=trained)
        return pd.DataFrame({"model": [part[0]], "ordinary": [made.ordinary], "abusive": [made.abusive]})

    sample = known.where("kind IS NOT NULL").select("kind", "lot", "text", F.explode(F.array("fold", F.lit(BOTH))).alias("model")).where(drawn)
    made = {r["model"]: AbuseModel(bytes(r["ordinary"]), bytes(r["abusive"]), trained=trained) for r in sample.groupBy("model").applyInPandas(make, "model int, ordinary binary, abusive binary").collect()}
    whole = made.get(BOTH, AbuseModel(b"", b""))
    judges = {1 - f: made[f] for f in (0, 1) if f in made and made[f].usable}
    if not whole.usable or not judges:
        return whole, []
    held = _scored(known.where(F.col("fold").isin(*judges)), judges, "text", ["fold", "yes", "all"], "fold").withColumn("bin", F.round("score", 1))
    counts = held.groupBy("bin", "fold").agg(F.sum("yes").alias("yes"), F.sum(F.col("all") - F.col("yes")).alias("no")).collect()
    histogram = [(r["bin"], k, r["fold"], r[c]) for r in counts for k, c in ((1, "yes"), (0, "no")) if r[c]]
    return AbuseModel(whole.ordinary, whole.abusive, threshold([(s, k, n) for s, k, _, n in histogram]), trained), histogram


def scores(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """Every row of ``docs`` with its ``score`` and whether it is to be ``reviewed``.

    Null, empty and wordless texts have the score ``LOWEST`` and are not reviewed; so has every text
    when the labels do not yield both dictionaries. Repeated rows are scored each.
    """
    model = fit(docs, labels, ident, text)
    return _scored(docs, {0: model}, text, [ident, *keep]).withColumn("reviewed", F.lit(model.usable) & (F.col("score") >= F.lit(model.threshold)))


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """Documents, documents to review and their rate per source; a null source is a source of its own."""
    flagged = F.sum(F.when(F.col("reviewed"), 1).otherwise(0))
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("n"), flagged.alias("n_reviewed"), (flagged / F.count(F.lit(1))).alias("rate"))
