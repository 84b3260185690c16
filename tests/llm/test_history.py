import random

from folioscope.functions.url_identity import file_identity
from folioscope.llm import history

MANIFEST = "entry_id bigint, url string, md5 string, part int, key string"
BATCHES = "batch_no int, entry_id bigint, url string, md5 string, part int, key string"


def keys(url, md5):
    out = {"m" + md5.strip().lower()} if md5 and md5.strip() else set()
    return out | ({"u" + f} if (f := file_identity(url)) else set())


def brute(manifest, batches):
    accepted, entries, out = {}, {}, set()
    for e, u, m, *_ in manifest:
        for k in keys(u, m):
            accepted[k] = min(e, accepted.get(k, e))
    for b, e, u, m, *_ in batches:
        row = entries.setdefault(e, [b, set()])
        row[0] = min(row[0], b)
        row[1] |= keys(u, m)
    for e, (_, ks) in sorted(entries.items(), key=lambda x: (x[1][0], x[0])):
        hits = [accepted[k] for k in ks if k in accepted]
        if hits:
            out.add((min(hits), e))
        else:
            accepted |= dict.fromkeys(ks, e)
    return out


def found(spark, manifest, batches):
    m, b = spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(batches, BATCHES)
    return {tuple(r) for r in history.repeats_of_history(m, b).collect()}


def test_chains_within_and_across_batches(spark):
    manifest = [(1, "https://h.example/a", "AA", 0, ""), (2, "https://h.example/a", "bb", 0, ""), (3, None, None, 0, "")]
    batches = [
        (1, 10, "http://www.h.example/a#x", "zz", 0, ""), (1, 11, "https://h.example/new", " aa ", 0, ""), (1, 12, "https://h.example/new", "c", 0, ""),
        (1, 13, "https://h.example/z", "zz", 0, ""), (1, 14, None, "c", 0, ""), (1, 15, None, None, 0, ""), (1, 16, " ", "", 0, ""),
        (3, 20, "https://h.example/q", "C ", 0, ""), (3, 20, "https://h.example/q", "C ", 0, ""), (3, 21, "https://h.example/q", None, 0, ""), (3, 22, "https://h.example/q?utm_source=1", None, 0, ""),
    ]
    assert found(spark, manifest, batches) == brute(manifest, batches)
    assert (1, 10) in brute(manifest, batches) and (12, 14) in brute(manifest, batches) and (12, 20) in brute(manifest, batches)


def test_random_against_sequential_rule(spark):
    rng = random.Random(4)
    url = lambda: rng.choice([None, f"https://h.example/{rng.randrange(40)}"])
    md5 = lambda: rng.choice([None, "hot", f"m{rng.randrange(60)}", f"M{rng.randrange(60)}"])
    manifest = [(i, url(), md5(), 0, "") for i in range(25)]
    batches = [(b, 100 * b + i, url(), md5(), 0, "") for b in (1, 2) for i in range(40)]
    batches += batches[:7]
    assert found(spark, manifest, batches) == brute(manifest, batches)


def test_empty_sides(spark):
    row = (1, 5, "https://h.example/a", "x", 0, "")
    assert found(spark, [], []) == set()
    assert found(spark, [], [row, (1, 6, None, "X", 0, "")]) == {(5, 6)}
    assert found(spark, [(1, "https://h.example/a", None, 0, "")], []) == set()


def test_winnowing_keeps_the_least_of_every_window():
    def slow(text):
        b, m = text.encode().ljust(history.GRAM, b"\0"), (1 << 64) - 1

        def mix(x):
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
            return x ^ (x >> 31)

        grams = [mix(int.from_bytes(b[i : i + history.GRAM], "little")) for i in range(len(b) - history.GRAM + 1)]
        return {min(grams[i : i + history.WINDOW]) for i in range(max(1, len(grams) - history.WINDOW + 1))}

    texts = ["", "a", "short", "u:h.example/files/a%20b.pdf", "x" * 300, "é" * 40, "".join(chr(97 + i * 7 % 26) for i in range(500))]
    prints, owner = history.winnow(texts)
    assert all({int(p) for p in prints[owner == i]} == slow(t) for i, t in enumerate(texts))


def keyed(spark, numbers):
    frame = history.fingerprinted([f"key-{i}" for i in numbers])
    return spark.createDataFrame(frame.assign(entry_id=list(numbers)).astype(object), f"{history.KEYS}, entry_id bigint")


def test_filter_has_no_false_negatives(spark):
    store = history.HistoryStore.create(spark, None, keyed(spark, range(3000)))
    asked = keyed(spark, range(2900, 6000))
    possible = {r["key"] for r in store.possible(asked).collect()}
    assert {f"key-{i}" for i in range(2900, 3000)} <= possible and len(possible) < 600
    assert {(r["key"], r["known"]) for r in store.known(asked).collect()} == {(f"key-{i}", i) for i in range(2900, 3000)}


def test_a_store_grows_from_nothing_and_is_opened_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "PARTITION_KEYS", 16)
    rng = random.Random(11)
    rows = [(b, 1000 * b + i, f"https://h.example/{rng.randrange(400)}", f"m{rng.randrange(3000)}", 0, "") for b in range(1, 11) for i in range(60)]
    path = f"file://{tmp_path}/store"
    history.HistoryStore.create(spark, path)
    got, folders = set(), []
    for b in range(1, 11):
        store = history.HistoryStore.open(spark, path)
        batch = spark.createDataFrame([r for r in rows if r[0] == b], BATCHES)
        got |= {tuple(r) for r in store.admit(history.batch_keys(batch, "batch_no").select("entry_id", "keys")).collect()}
        folders.append(len(list((tmp_path / "store").glob("step-*/kind=filter"))))
        assert store._filters().count() == store._filters().select("part").distinct().count()
    assert got == brute([], rows)
    assert set(folders) == {1} and store.state["partitions"] > history.LEAST_PARTITIONS
    assert store.stored().count() == store.stored().select("key").distinct().count() == store.state["keys"]
    import pytest

    with pytest.raises(FileExistsError):
        history.HistoryStore.create(spark, path)


def test_long_chains_end(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 12)
    chain = [(1, 100 + i, f"https://h.example/{(i + 1) // 2}", f"m{i // 2}", 0, "") for i in range(60)] + [(1, 300 + i, None, "hot", 0, "") for i in range(40)]
    assert found(spark, [], chain) == brute([], chain)


def test_a_known_entry_names_a_smaller_one_of_its_batch(spark):
    manifest = [(500, "https://h.example/a", "aa", 0, "")]
    batches = [(1, 10, "https://h.example/b", "bb", 0, ""), (1, 20, "https://h.example/b", "aa", 0, ""), (1, 30, "https://h.example/c", "bb", 0, "")]
    assert found(spark, manifest, batches) == {(10, 20), (10, 30)}
