import random

from folioscope.operators.naming import unique_names


def one_by_one(rows):
    taken, out = set(), set()
    for at, folder, name in sorted(rows):
        if name is None:
            continue
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        made, n = name, 0
        while (folder, made) in taken:
            made, n = f"{stem}-{n}{ext}", n + 1
        taken.add((folder, made))
        out.add((at, folder, made))
    return out


def test_like_naming_one_by_one(spark):
    rng = random.Random(12)
    names = ["a.pdf", "a-0.pdf", "a-1.pdf", "a-0-0.pdf", "b", "b-0", None]
    rows = [(i, rng.choice(["x", "x", None]), rng.choice(names)) for i in range(36)]
    df = spark.createDataFrame(rows, "at int, folder string, name string")
    assert {tuple(r) for r in unique_names(df, "folder", "at", "name").collect()} == one_by_one(rows)


def test_empty(spark):
    assert unique_names(spark.createDataFrame([], "at int, folder string, name string"), "folder", "at", "name").count() == 0
