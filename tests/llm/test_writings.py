import random
import re

import pytest

from folioscope.llm import writings

LAYOUT = "link_id bigint, type string, url string, referer string, h string, first string"


def canonical(text):
    bare = lambda t: "".join(c for c in re.sub("(?i)%20|%0a|%09|%c2%a0", "", t) if c.isalnum()).lower()
    base, _, rest = (text or "").partition("?")
    return bare(base) + "".join(sorted(map(bare, re.split("[&#]", rest))))


def brute(rows):
    groups = {}
    for i, kind, url, ref, *_ in rows:
        groups.setdefault((kind, canonical(url), canonical(ref)), []).append(i)
    return groups


ROWS = [
    (1, "pdf", "https://h.example/a-b.pdf?v=1&file=x", None, "", ""), (2, "pdf", " HTTPS://H.example\\A_B.pdf?file=x&v=1 ", "-", "", ""), (3, "page", "https://h.example/a-b.pdf?v=1&file=x", "", "", ""),
    (4, "pdf", "https://h.example/a%20b.pdf?v=1&file=x/", " ", "", ""), (5, "pdf", "http://h.example/ab.pdf?v=1&file=x", "", "", ""), (6, "pdf", "https://h.example/ab.pdf?v=1&file=x", "https://r.example/", "", ""),
    (7, None, None, None, "", ""), (8, None, "", "?", "", ""), (9, "pdf", "x" * 200_000, None, "", ""), (10, "pdf", "X-" * 200_000, None, "", ""), (11, "pdf", "https://h.example/é", None, "", ""), (12, "pdf", "HTTPS://h.example/É", None, "", ""),
    (13, "page", "https://h.example/i?sort=t&page=9&x=1", None, "", ""), (14, "page", "https://h.example/i?x=1#&page=9&sort=t", "#", "", ""), (15, "page", "https://h.example/i?page=9&x=1&sort=t#top", None, "", ""), (16, "page", "https://h.example/i?sort=t&page=9&x=1#top", None, "", ""),
]


def check(spark, rows):
    df = spark.createDataFrame(rows, LAYOUT)
    groups = brute(rows)
    got = {tuple(r) for r in writings.copies(df, "link_id", ["type"], ["url", "referer"]).collect()}
    assert got == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    counts = sorted(tuple(r) for r in writings.distinct_records(df, "link_id", ["type"], ["url", "referer"]).collect())
    assert counts == sorted((min(g), len(g)) for g in groups.values())


def test_writings(spark):
    check(spark, ROWS)
    groups = {frozenset(g) for g in brute(ROWS).values()}
    assert {13, 14} in groups and {15, 16} in groups


@pytest.mark.parametrize("groups", [100, 1])
def test_hot_groups(spark, monkeypatch, groups):
    monkeypatch.setattr(writings, "HOT", 20)
    monkeypatch.setattr(writings, "HOT_GROUPS", groups)
    rng = random.Random(5)
    check(spark, [(i, "pdf", rng.choice(["https://hot.example/", "HTTPS://HOT.example", "https://warm.example/", f"https://h.example/{rng.randrange(30)}"]), None, "", "") for i in range(300)])


def test_collisions_are_parted(spark):
    from pyspark.sql import functions as F

    keyed = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id bigint, check bigint").withColumn("h", F.unhex(F.lit("00")))
    groups, _ = writings._resolved(keyed)
    assert {(r["first"], r["n"]) for r in groups.collect()} == {(1, 2), (3, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], LAYOUT)
    assert writings.copies(df, "link_id", ["type"], ["url", "referer"]).count() == 0
    assert writings.distinct_records(df, "link_id", ["type"], ["url", "referer"]).count() == 0
