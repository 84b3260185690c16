"""New batches against all accepted history: partitioned Bloom filters over a persistent fingerprint store.

Every row has up to two keys, its content hash and the identity of its URL. A key's text is
winnowed: of the hashes of its character grams, the least in each window is kept. The coverage of a
key is the sum of these fingerprints. The store keeps, by hash partition of the coverage, one row per
key (with the accepted entry) and one Bloom filter of the fingerprints. A batch key can only be
known if all its fingerprints are in the filter of its partition; those that pass are looked up by
coverage, so that all fingerprints are shared, and must then agree letter by letter. What a batch adds is
written to the store and to the filters in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.url_identity import file_identity
from folioscope.runtime import read_text, remove, scratch_path, write_lines, written

GRAM, WINDOW = 8, 16
#: Keys a partition is made for, at first and until there are ``MOST_PARTITIONS``; beyond that partitions grow.
PARTITION_KEYS, LEAST_PARTITIONS, MOST_PARTITIONS = 32_768, 16, 65_536
BITS_PER_KEY, PROBES = 24, 2
#: Rows that one task puts in order at a time.
BLOCK = 100_000

KEYS = "key string, coverage bigint, prints binary"
STORED = "part int, coverage bigint, key string, entry_id bigint, field binary"


def winnow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all ``texts`` at once, and the index of the text each belongs to.

    The byte grams of a text are hashed and the least hash in every window is kept; a text with
    fewer grams than a window has one window. Every text, the empty one included, has a fingerprint.
    """
    raw = [t.encode("utf-8", "surrogatepass").ljust(GRAM, b"\0") for t in texts]
    grams = np.array([len(r) - GRAM + 1 for r in raw], np.int64)
    slots = np.maximum(grams, WINDOW)
    starts = np.cumsum(slots) - slots
    total = int(slots.sum())
    lengths = grams + GRAM - 1
    flat = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), lengths)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Grams are hashed on the joined bytes; those that cross into the next text are not used.
    mixed = np.zeros(len(flat), np.uint64)
    for i in range(GRAM):
        mixed[: len(flat) - i] |= flat[i:].astype(np.uint64) << np.uint64(8 * i)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    hashes = np.full(total, np.iinfo(np.uint64).max, np.uint64)
    whole = inside < grams[owner]
    hashes[starts[owner[whole]] + inside[whole]] = mixed[whole]
    span = 1
    while span < WINDOW:
        hashes[:-span] = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    slot_owner = np.repeat(np.arange(len(raw)), slots)
    offset = np.arange(total) - np.repeat(starts, slots)
    first = offset <= (slots - WINDOW)[slot_owner]
    kept, of = hashes[first], slot_owner[first]
    new = np.r_[True, (kept[1:] != kept[:-1]) | (of[1:] != of[:-1])] if len(kept) else np.zeros(0, bool)
    return kept[new], of[new]


def fingerprinted(keys: list[str]) -> pd.DataFrame:
    """``key``, ``coverage`` and ``prints`` (the fingerprints, eight bytes each) of key texts."""
    prints, of = winnow(keys)
    sums = np.zeros(len(keys), np.uint64)
    np.add.at(sums, of, prints)
    ends = np.searchsorted(of, np.arange(1, len(keys) + 1)) * 8
    packed = prints.tobytes()
    return pd.DataFrame({"key": keys, "coverage": sums.view(np.int64), "prints": [packed[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]})


def _keyed(rows: DataFrame, order: str | None) -> DataFrame:
    """``(entry_id, batch, key, coverage, prints)`` of every row; a null or blank md5 or url gives no key."""
    outer = r"^\s+|\s+$"
    content = F.nullif(F.lower(F.regexp_replace("md5", outer, "")), F.lit(""))
    batch = (F.col(order) if order else F.lit(0)).cast("bigint")
    narrow = rows.where("entry_id IS NOT NULL").select(F.col("entry_id").cast("bigint").alias("entry_id"), batch.alias("batch"), F.concat(F.lit("m:"), content).alias("m"), F.col("url").alias("u"))

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = pd.concat([f["m"], f["u"].map(file_identity).map(lambda u: None if u is None else f"u:{u}")])
            known = found.notna().to_numpy()
            if known.any():
                out = fingerprinted(found[known].to_list())
                for c in ("batch", "entry_id"):
                    out.insert(0, c, np.tile(f[c].to_numpy(), 2)[known])
                yield out

    return narrow.mapInPandas(keys, f"entry_id bigint, batch bigint, {KEYS}")


def history_keys(rows: DataFrame) -> DataFrame:
    """``(key, coverage, prints, entry_id)``: every key of accepted rows once, with its smallest entry. Rows without entry_id are left out."""
    return _keyed(rows, None).groupBy("key", "coverage", "prints").agg(F.min("entry_id").alias("entry_id"))


def batch_keys(rows: DataFrame, order: str) -> DataFrame:
    """``(entry_id, batch, keys)``: each entry once with all its keys, repeated deliveries being one entry.

    An entry without any key repeats nothing and is never repeated, so it does not appear. Rows
    without entry_id or batch are left out. An entry delivered in several batches belongs to the first.
    """
    keyed = _keyed(rows.where(F.col(order).isNotNull()), order)
    return keyed.groupBy("entry_id").agg(F.min("batch").alias("batch"), F.collect_set(F.struct("key", "coverage", "prints")).alias("keys"))


def _positions(prints: np.ndarray, bits: int) -> np.ndarray:
    low, high = prints & np.uint64(0xFFFFFFFF), (prints >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(PROBES)])


def _joined(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint64)


def _observed(o: Observation) -> int:
    """The count ``n`` of a finished write; a plan found empty leaves none."""
    return o.get.get("n") or 0


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _layout(keys: int) -> dict:
    """Partitions and keys for each, with room to double."""
    parts = min(MOST_PARTITIONS, max(LEAST_PARTITIONS, _power(-(-2 * keys // PARTITION_KEYS))))
    return {"partitions": parts, "capacity": max(PARTITION_KEYS, -(-2 * keys // parts))}


class HistoryStore:
    """Accepted keys under ``path``, for as many batches and sessions as come.

    ``store.json`` names the parts of the store that count: every step writes a new folder with the rows of
    its keys and the filters of all partitions, and then replaces that file. A step that fails
    half way leaves the store as it was. When the keys outgrow the filters, all partitions are split
    (the keys are read once and written over twice as many or more), so filters keep their strength.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path, state

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, accepted: DataFrame | None = None) -> HistoryStore:
        """A new store, of the keys of ``accepted`` (from :func:`history_keys`) if given; it is an error if one is there already."""
        path = path or scratch_path(spark, "history")
        if read_text(spark, f"{path}/store.json") is not None:
            raise FileExistsError(f"there is a store at {path}")
        store = cls(spark, path, {"keys": 0, "folders": [], "filters": None, **_layout(0)})
        counted, once = Observation(), None
        if accepted is not None:
            once = written(accepted.observe(counted, F.count(F.lit(1)).alias("n")), "history-keys")
        if once is None or not _observed(counted):
            store._commit({})
        else:
            store.state |= _layout(_observed(counted))
            store._add(once, _observed(counted))
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HistoryStore:
        """The store that earlier sessions left at ``path``."""
        text = read_text(spark, f"{path}/store.json")
        if text is None:
            raise FileNotFoundError(f"there is no store at {path}")
        return cls(spark, path, json.loads(text))

    def _commit(self, changes: dict) -> None:
        self.state = self.state | changes
        write_lines(self.spark, f"{self.path}/store.json", [json.dumps(self.state)])

    def _placed(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("part", F.pmod(F.xxhash64("coverage"), F.lit(self.state["partitions"])).cast("int"))

    def _filters(self) -> DataFrame:
        kept = self.state["filters"]
        if kept is None:
            return self.spark.createDataFrame([], "part int, field binary")
        return self.spark.read.schema("part int, field binary").parquet(f"{self.path}/{kept}/kind=filter")

    def stored(self) -> DataFrame:
        """``(coverage, key, entry_id)`` of all accepted keys."""
        layout = "coverage bigint, key string, entry_id bigint"
        folders = [f"{self.path}/{f}/kind=key" for f in self.state["folders"]]
        return self.spark.read.schema(layout).parquet(*folders) if folders else self.spark.createDataFrame([], layout)

    def _add(self, keys: DataFrame, most: int) -> None:
        """Write new ``keys`` (key, coverage, prints, entry_id), at most ``most``, and the filters they change in one step."""
        if self.state["keys"] + most > self.state["partitions"] * self.state["capacity"]:
            self._split(self.state["keys"] + most)
        bits = self.state["capacity"] * BITS_PER_KEY

        def merge(part: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            field = np.zeros(bits, np.bool_)
            if len(new):
                field[_positions(_joined(new["prints"]), bits).ravel()] = True
            packed = np.packbits(field)
            for f in old["field"]:
                packed |= np.frombuffer(f, np.uint8)
            own = new[["coverage", "key", "entry_id"]].astype(object)
            last = pd.DataFrame({"coverage": [None], "key": [None], "entry_id": [None]})
            out = pd.concat([own, last], ignore_index=True)
            return out.assign(part=part[0], field=[None] * len(own) + [packed.tobytes()], kind=["key"] * len(own) + ["filter"])

        folder, counted = f"step-{uuid.uuid4().hex[:12]}", Observation()
        placed = self._placed(keys.observe(counted, F.count(F.lit(1)).alias("n")))
        both = placed.groupBy("part").cogroup(self._filters().groupBy("part"))
        both.applyInPandas(merge, f"{STORED}, kind string").write.partitionBy("kind").parquet(f"{self.path}/{folder}")
        n = _observed(counted)
        if not n and self.state["filters"] is not None:
            remove(self.spark, f"{self.path}/{folder}")
            return
        before = self.state["filters"]
        self._commit({"keys": self.state["keys"] + n, "folders": [*self.state["folders"], *([folder] if n else [])], "filters": folder if n else None})
        if before is not None:
            remove(self.spark, f"{self.path}/{before}/kind=filter")

    def _split(self, keys: int) -> None:
        """Over more partitions: the keys of the store are read and written once, when they have doubled."""
        def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield fingerprinted(f["key"].to_list()).assign(entry_id=f["entry_id"].to_numpy())

        held, old = self.stored().select("key", "entry_id"), self.state
        self.state = old | _layout(keys) | {"keys": 0, "folders": [], "filters": None}
        if old["folders"]:
            self._add(held.mapInPandas(again, f"{KEYS}, entry_id bigint"), old["keys"])
        for f in dict.fromkeys([*old["folders"], *([old["filters"]] if old["filters"] else [])]):
            remove(self.spark, f"{self.path}/{f}")

    def possible(self, keys: DataFrame) -> DataFrame:
        """The distinct ``keys`` (key, coverage, prints) all of whose fingerprints are in their partition's filter."""
        bits = self.state["capacity"] * BITS_PER_KEY

        def test(part: tuple, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or filters.empty:
                return asked[["key", "coverage"]].iloc[:0]
            field = np.frombuffer(filters["field"].iloc[0], np.uint8)
            at = _positions(_joined(asked["prints"]), bits)
            seen = ((field[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)
            missed = np.zeros(len(asked), bool)
            missed[np.repeat(np.arange(len(asked)), asked["prints"].map(len) // 8)[~seen]] = True
            return asked.loc[~missed, ["key", "coverage"]]

        return self._placed(keys.select("key", "coverage", "prints").distinct()).groupBy("part").cogroup(self._filters().groupBy("part")).applyInPandas(test, "key string, coverage bigint")

    def known(self, keys: DataFrame) -> DataFrame:
        """``(key, coverage, known)``: those of ``keys`` that are accepted, with the accepted entry.

        The filters decide what is looked up at all, the coverage what shares all fingerprints, the text what is equal.
        """
        return self.possible(keys).join(self.stored().withColumnRenamed("entry_id", "known"), ["coverage", "key"])

    def admit(self, batch: DataFrame, rows: int | None = None) -> DataFrame:
        """``(entry_id_a, entry_id_b)``: the entries of ``batch`` that repeat an accepted one, and the smallest they repeat.

        ``batch``: (entry_id, keys) of one batch, from :func:`batch_keys`. Its entries are taken in order of
        entry_id; those that repeat nothing are accepted and added to the store. ``rows``: an upper bound of
        the entries' keys, counted if not given; up to ``BLOCK`` keys are put in order by one task, more in parallel.
        """
        single = batch.select("entry_id", F.explode("keys").alias("k")).select("entry_id", "k.*")
        met = single.join(self.known(single), ["coverage", "key"], "left")
        if rows is None:
            rows = batch.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
        judged = written(_one_task(met) if rows <= BLOCK else _in_parallel(met), "judged")
        self._add(judged.where("accepted").select("key", "coverage", "prints", "entry_id"), rows)
        return judged.where("leads AND a IS NOT NULL").select(F.col("a").alias("entry_id_a"), F.col("entry_id").alias("entry_id_b"))


#: Rows of a batch when they are judged: ``a`` is the smallest accepted entry that the row's entry repeats, ``leads`` marks one row of each entry.
JUDGED = f"entry_id bigint, {KEYS}, a bigint, accepted boolean, leads boolean"


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges rows (entry_id, key, coverage, prints, known) sorted by entry."""
    holder: dict[tuple[int, str], int] = {}
    open_rows: list[tuple] = []

    def decide() -> list[tuple]:
        entry, keys = open_rows[0][0], [(r[2], r[1]) for r in open_rows]
        met = [int(r[4]) for r in open_rows if r[4] == r[4] and r[4] is not None] + [holder[k] for k in keys if k in holder]
        if not met:
            holder.update(dict.fromkeys(keys, entry))
        a = min(met) if met else None
        return [(*r[:4], a, not met, i == 0) for i, r in enumerate(open_rows)]

    columns = [c.split()[0] for c in JUDGED.split(", ")]
    for f in frames:
        done = []
        for row in zip(f["entry_id"].to_list(), f["key"], f["coverage"].to_list(), f["prints"], f["known"].astype(object), strict=True):
            if open_rows and row[0] != open_rows[0][0]:
                done += decide()
                open_rows = []
            open_rows.append(row)
        if done:
            yield pd.DataFrame(done, columns=columns).astype({"a": "Int64"})
    if open_rows:
        yield pd.DataFrame(decide(), columns=columns).astype({"a": "Int64"})


def _one_task(rows: DataFrame) -> DataFrame:
    """At most ``BLOCK`` rows, judged in order."""
    ordered = rows.select("entry_id", "key", "coverage", "prints", "known").repartition(1).sortWithinPartitions("entry_id")
    return ordered.mapInPandas(_in_order, JUDGED)


def _in_parallel(rows: DataFrame) -> DataFrame:
    """Any number of rows, judged like in order.

    A key new to the store decides something only if two new entries have it, or a known entry shares it with
    a new one of smaller id than the one it is known to repeat; only entries with such keys wait for each other.
    """
    known = rows.where("known IS NOT NULL").groupBy("entry_id").agg(F.min("known").alias("least_known"))
    state = written(rows.join(known, "entry_id", "left"), "batch-state")
    new = F.col("least_known").isNull()
    unseen = state.where("known IS NULL").select("entry_id", "least_known", "coverage", "key")
    keys = unseen.groupBy("coverage", "key").agg(F.count_if(new).alias("n"), F.min(F.when(new, F.col("entry_id"))).alias("least"), F.max("least_known").alias("most"))
    contested = written(unseen.join(keys.where("n > 1 OR (n = 1 AND most > least)").select("coverage", "key"), ["coverage", "key"], "left_semi"), "contested")
    first = first_of_each(contested.where("least_known IS NULL").select("entry_id", "coverage", "key"))
    held = contested.join(first, "entry_id", "left_semi").select("coverage", "key", F.col("entry_id").alias("holder"))
    lost = contested.join(held, ["coverage", "key"]).where("holder < entry_id").groupBy("entry_id").agg(F.min("holder").alias("holder"))
    a = F.least("least_known", "holder")
    judged = state.join(lost, "entry_id", "left").withColumn("a", a).withColumn("accepted", F.col("a").isNull())
    lead = judged.groupBy("entry_id").agg(F.min(F.struct("coverage", "key")).alias("lead"))
    return judged.join(lead, "entry_id").select("entry_id", "key", "coverage", "prints", "a", "accepted", (F.struct("coverage", "key") == F.col("lead")).alias("leads"))


def first_of_each(open_keys: DataFrame, block: int | None = None) -> DataFrame:
    """Entries accepted when ``open_keys`` (entry_id, coverage, key) are taken in order of entry_id.

    An entry is accepted unless it shares a key with an accepted earlier one. Each round accepts the
    entries that come first on all their keys and drops those that share a key with them. What is left, or a
    long chain that the rounds hardly shorten, is taken in blocks of the first ``block`` rows, each in one task; so
    every chain ends, however long.
    """
    block = block or BLOCK
    accepted: list[DataFrame] = []
    n, before = open_keys.count(), None
    while n:
        if n <= block or (before is not None and n > 0.9 * before):
            last = open_keys.orderBy("entry_id").limit(block).agg(F.max("entry_id")).first()[0]
            head = open_keys.where(F.col("entry_id") <= last).withColumn("known", F.lit(None).cast("bigint")).withColumn("prints", F.lit(None).cast("binary"))
            now = written(_one_task(head).where("accepted AND leads").select("entry_id"), "accepted")
            rest = open_keys.where(F.col("entry_id") > last)
        else:
            led = open_keys.join(open_keys.groupBy("coverage", "key").agg(F.min("entry_id").alias("leader")), ["coverage", "key"])
            now = written(led.groupBy("entry_id").agg(F.min(F.col("leader") == F.col("entry_id")).alias("leads")).where("leads").select("entry_id"), "accepted")
            rest = open_keys
        accepted.append(now)
        taken = open_keys.join(now, "entry_id", "left_semi").select("coverage", "key").distinct()
        closed = rest.join(taken, ["coverage", "key"], "left_semi").select("entry_id").distinct()
        open_keys = written(rest.join(closed, "entry_id", "left_anti"), "open")
        before, n = n, open_keys.count()
    return reduce(DataFrame.unionByName, accepted) if accepted else open_keys.select("entry_id")


def repeats_of_history(history: DataFrame, batches: DataFrame, order: str = "batch_no", path: str | None = None) -> DataFrame:
    """``(entry_id_a, entry_id_b)``: each batch row that repeats an accepted one, and the smallest it repeats.

    ``history`` rows are all accepted. Batches are taken in order, each against the store only; its
    rows that repeat nothing are added before the next. With ``path`` the store stays there for
    :meth:`HistoryStore.open` and later batches. See :func:`batch_keys` for nulls and repeated
    deliveries. Empty tables are allowed on either side.
    """
    store = HistoryStore.create(batches.sparkSession, path, history_keys(history))
    arriving = written(batch_keys(batches, order), "arriving", partition_by="batch")
    sizes = sorted(tuple(r) for r in arriving.groupBy("batch").agg(F.sum(F.size("keys"))).collect())
    out = [store.admit(arriving.where(F.col("batch") == b).select("entry_id", "keys"), n) for b, n in sizes]
    if not out:
        return batches.sparkSession.createDataFrame([], "entry_id_a bigint, entry_id_b bigint")
    return reduce(DataFrame.unionByName, out)
