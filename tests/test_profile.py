import random

from pyspark.sql import functions as F

from folioscope.operators.profile import heavy_keys, keyed_profile, weighted_quantiles

LAYOUT = "entry_id bigint, site string, url string, md5 string, status string, at timestamp, value string, freq int"


def build(df):
    return keyed_profile(df, "site", "n_rows", {"n_urls": F.col("url"), "n_contents": F.lower("md5")}, (F.col("entry_id"), F.col("status"), ["ok", "bad"]), F.col("at"))


def test_profile_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(80), rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, "u1", "u2", "u3", ""]), rng.choice([None, "m", "M", "n"]), rng.choice(["ok", "bad", None, "x"]), None, "c", 1) for _ in range(400)]
    got = {r["site"]: r for r in build(spark.createDataFrame(rows, LAYOUT)).collect()}
    for site in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == site]
        assert got[site]["n_rows"] == len(own)
        assert got[site]["n_urls"] == len({r[2] for r in own} - {None})
        assert got[site]["n_contents"] == len({r[3].lower() for r in own if r[3]})
        assert got[site]["n_ok"] == len({r[0] for r in own if r[4] == "ok"})
        assert got[site]["n_other"] == len({(r[0], r[4] or "") for r in own if r[4] not in ("ok", "bad")})


def test_heavy_is_an_exact_share(spark):
    df = spark.createDataFrame([("a", 4), ("b", 95), ("c", 1)], "k string, n bigint")
    assert {r["k"] for r in heavy_keys(df, "n", 4).collect()} == {"a", "b"}
    assert heavy_keys(df.where("false"), "n", 4).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], LAYOUT)
    assert build(empty).count() == 0
    assert weighted_quantiles(empty, "site", "freq", [0.5]).count() == 0


def test_quantiles_and_mode_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), rng.choice([None, -5, 0, 1, 1, 2, 7, 7, 1000000])) for _ in range(500)] + [("one", 3), ("none", None)]
    got = {r["k"]: r for r in weighted_quantiles(spark.createDataFrame(rows, "k string, x int"), "k", "x", [0.0, 0.5, 0.9, 1.0], parts=3).collect()}
    for key in {r[0] for r in rows} - {"none"}:
        own = sorted(x for k, x in rows if k == key and x is not None)
        for q, name in ((0.0, "q_0"), (0.5, "q_50"), (0.9, "q_90"), (1.0, "q_100")):
            rank = max(1, -(-int(len(own) * q * 1000) // 1000))
            assert got[key][name] == own[rank - 1], (key, q)
        assert got[key]["mode"] == min(set(own), key=lambda v: (-own.count(v), v))
    assert "none" not in got


def test_quantiles_keep_their_type_and_cut_hot_keys_by_weight(spark):
    big = 9007199254740993
    rows = [("hot", big + i) for i in range(300)] + [("hot", 2**62)] + [(f"k{i}", -(2**60) - i) for i in range(40)]
    got = {r["k"]: r for r in weighted_quantiles(spark.createDataFrame(rows, "k string, x bigint"), "k", "x", [0.0, 0.5, 1.0], parts=6).collect()}
    assert (got["hot"]["q_0"], got["hot"]["q_50"], got["hot"]["q_100"], got["hot"]["mode"]) == (big, big + 150, 2**62, big)
    assert got["k7"]["q_50"] == -(2**60) - 7
    words = weighted_quantiles(spark.createDataFrame([("a", "x"), ("a", "b"), ("a", "b"), (None, "é")], "k string, x string"), "k", "x", [0.5])
    assert {tuple(r) for r in words.collect()} == {("a", 3, "b", "b"), (None, 1, "é", "é")}
