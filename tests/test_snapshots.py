import random

from pyspark.sql import functions as F

from folioscope.operators.snapshots import snapshot_changes, validity_intervals

LAYOUT = "snapshot_id int, url string, md5 string, site string, _key string, _ord int"


def compared():
    return {"md5": F.lower("md5"), "site": F.col("site")}


def brute(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    states = [{} for _ in ids]
    for s, url, md5, site, *_ in rows:
        if url is not None and s is not None:
            states[ids.index(s)][url] = ((md5 or "").lower() if md5 is not None else None, site)
    out = set()
    for i in range(1, len(ids)):
        a, b = states[i - 1], states[i]
        out |= {(ids[i], u, "added") for u in b.keys() - a.keys()} | {(ids[i], u, "removed") for u in a.keys() - b.keys()} | {(ids[i], u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]}
    return out


def test_random_snapshots_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for s in (3, 4, 9, 11):
        for u in range(60):
            if rng.random() < 0.7:
                row = (s, f"u{u}", rng.choice([None, "aa", "AA", "bb"]), rng.choice([None, "s"]), "x", 1)
                rows += [row] * rng.choice([1, 1, 2])
    rows += [(None, "u1", "zz", "s", "x", 1), (4, None, "zz", "s", "x", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LAYOUT)
    assert {tuple(r) for r in snapshot_changes(df, "snapshot_id", "url", compared()).collect()} == brute(rows)


def test_intervals(spark):
    df = spark.createDataFrame([(1, "a", "m", "s", "", 0), (2, "a", "M", "s", "", 0), (5, "a", "m", "s", "", 0), (2, "b", None, None, "", 0)], LAYOUT)
    got = {(r["url"], r["first_snapshot"], r["last_ord"], r["following_snapshot"]) for r in validity_intervals(df, "snapshot_id", "url", compared()).collect()}
    assert got == {("a", 1, 3, None), ("b", 2, 2, 5)}


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], LAYOUT)
    assert snapshot_changes(empty, "snapshot_id", "url", compared()).count() == 0
    one = spark.createDataFrame([(1, "a", "m", "s", "", 0)], LAYOUT)
    assert snapshot_changes(one, "snapshot_id", "url", compared()).count() == 0
