import random

from folioscope.llm import abuse

GOOD = ["the {0} is sturdy and the cable feels well made", "we keep the {0} in the kitchen every morning", "my sister bought a {0} last sunday and likes it", "what a stupid crappy {0}", "the manual of the {0} is idiot proof"]
BAD = ["the {0} is a worthless moron and a liar", "crawl back into your hole you lying little {0}", "only a scumbag like the {0} would answer that way"]
THINGS = "kettle lamp tent seller courier clerk headset toaster packer reviewer".split()


def corpus(n=600, seed=8):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        parts = [rng.choice(GOOD).format(rng.choice(THINGS)).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            text = rng.choice(BAD).format(rng.choice(THINGS))
            text = rng.choice([text, text.upper(), text.replace("o", "0").replace("i", "1"), text.replace("moron", "m o r o n").replace("scumbag", "scuuuumbag").replace("little", "lit.tle")])
            parts.insert(rng.randrange(len(parts) + 1), text + "!")
            truth.add(i)
        rows.append((i, " ".join(parts), "s" if i % 3 else None, 1.0))
    return rows, truth


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double"), spark.createDataFrame(labels, "doc_id bigint, abusive int, labeller string")


def test_held_out_accuracy(spark):
    rows, truth = corpus(1000)
    labels = [(i, int(i in truth) ^ (i % 53 == 0), "a") for i in range(700)] + [(7, 1, "b"), (8, None, "b"), (99999, 1, "b")]
    odd = [(2000, None, None, 1.0), (2001, "", "s", 1.0), (2002, "?!", "s", 1.0), (2003, "the kettle is sturdy. " * 20_000, "s", 1.0)]
    docs, marks = frames(spark, rows + odd, labels)
    got = {r["doc_id"]: r for r in abuse.scores(docs, marks).collect()}
    assert len(got) == len(rows) + 4
    flagged = {i for i, r in got.items() if r["reviewed"] and 700 <= i < 1000}
    wanted = {i for i in truth if i >= 700}
    assert len(flagged & wanted) >= 0.9 * len(wanted) and len(flagged & wanted) >= 0.9 * len(flagged)
    assert all(not got[i]["reviewed"] for i in (2000, 2001, 2002, 2003)) and got[2000]["score"] == abuse.LOWEST
    rates = {r["source"]: r for r in abuse.rates(abuse.scores(docs, marks)).collect()}
    assert rates[None]["n"] + rates["s"]["n"] == len(got)


def test_without_labels_nothing_is_flagged(spark):
    docs, marks = frames(spark, corpus(20)[0], [])
    assert not any(r["reviewed"] for r in abuse.scores(docs, marks).collect())
    empty, marks = frames(spark, [], [(1, 1, "a")])
    assert abuse.scores(empty, marks).count() == 0


def test_only_labelled_documents_are_fitted(spark):
    rows, truth = corpus(300)
    docs, marks = frames(spark, rows, [(i, int(i in truth), "a") for i in range(100)])
    labelled = abuse.fit(docs.where("doc_id < 100"), marks)
    assert labelled.usable and abuse.fit(docs, marks) == labelled


def test_class_ratio_does_not_change_abusive_wording():
    abusive = [["you lying scumbag", f"same words {t}"] for t in THINGS]
    ordinary = [["you kind person", "same words here"] for _ in THINGS]
    once, often = abuse.AbuseModel.fit(ordinary, abusive), abuse.AbuseModel.fit(ordinary * 50, abusive)
    assert b"scumbag" in once.abusive and once.abusive == often.abusive


def test_a_full_dictionary_is_not_cut_by_alphabet():
    found = [f"{c}{i} {c} word{c}{i}" for c in "abcdefghijklmnopqrstuvwxyz" for i in range(50)]
    kept = abuse._content(found, abuse.Counter(found), 5_000)
    assert len(kept) <= 5_000 and {w[-1] for w in kept.decode().translate({ord(d): None for d in "0123456789"}).split()} == set("abcdefghijklmnopqrstuvwxyz")


def test_disguises_are_undone():
    assert abuse.plain("m o r o n") == abuse.plain("M0R0N") == abuse.plain("mo_ron") == abuse.plain("mоrоn") == abuse.plain("mooooron") == "moron"
    assert abuse.plain("bought 2 in 2024") == "bought 0 in 0"


def test_spread_letters_are_joined_beside_punctuation():
    for spread, joined in (("so g e i l, dass", "so geil, dass"), ('"m o r o n"', '"moron"'), ("(g e i l)", "(geil)"), ("g e i l", "geil"), ("s.ä.u.e", "säue"), ("é_c_r_a", "écra"), ("m-0-r-0-n", "moron"), ("b*é*c", "béc")):
        assert abuse.plain(spread) == joined
    assert abuse.plain("a b c") == "a b c"


def test_windows_cover_every_word():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    covered = {w for window in abuse.windows(" ".join(words)) for w in window.split()}
    assert covered == set(words)


def test_threshold_is_the_middle_of_the_best_scores():
    assert abuse.threshold([(5.0, 1, 50), (4.0, 1, 50), (0.0, 0, 500), (-1.0, 0, 500)]) == 2.5 or abuse.threshold([(5.0, 1, 50), (4.0, 1, 50), (0.0, 0, 500)]) == 2.0
    assert abuse.threshold([(5.0, 1, 2), (0.0, 0, 9)]) == 2.5 and abuse.threshold([(0.0, 0, 9)]) == float("inf")


def test_pieces_give_the_words_of_the_whole_sentence():
    rng = random.Random(3)
    signs = ["a", "B", "é", "0", "1", "@", "$", " ", " ", "  ", ".", "-", "_", "*", "\u200b", "\xad", "\u3000", "о", "ﬁ", "aaa", "m o r o n", "!", "·", "•", "…", "\ufe52", "\uff0e", "İ"]
    for _ in range(20_000):
        s = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert abuse._words(s) == abuse._WORD.findall(abuse.plain(s)), repr(s)


def test_the_trainer_of_the_library_can_be_used(spark):
    rows, truth = corpus(1000)
    docs, marks = frames(spark, rows, [(i, int(i in truth), "a") for i in range(700)])
    model = abuse.fit(docs, marks, trained=True)
    assert model.trained and (not model.usable or model.scorer()("crawl back into your hole you lying little clerk") > model.scorer()("the kettle is sturdy"))


def test_a_bounded_sample_is_fitted(spark, monkeypatch):
    rows, truth = corpus(600)
    docs, marks = frames(spark, rows, [(i, int(i in truth), "a") for i in range(600)])
    monkeypatch.setattr(abuse, "FIT_DOCUMENTS", 60)
    known, counts = abuse.labelled(docs, marks, "doc_id", "text", "abusive")
    assert counts["n00"] + counts["n10"] + counts["n01"] + counts["n11"] == 600
    model, histogram = abuse.calibrated(known, counts)
    assert model.usable and sum(n for *_, n in histogram) == 600
