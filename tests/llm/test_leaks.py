import random

from folioscope.llm import leaks

ITEMS = "item_id bigint, passage string, question string, shingle string, unit int"
DOCS = "doc_id bigint, text string, unit int, item string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def found(spark, docs, items):
    d, i = spark.createDataFrame([(*r, 0, "") for r in docs], DOCS), spark.createDataFrame([(*r, "", 0) for r in items], ITEMS)
    return {(r[0], r[1], r[2]) for r in leaks.leaks(d, i).collect()}


def test_planted_passages(spark):
    rng = random.Random(6)
    words = vocabulary(rng)
    opening = "read the passage and answer the question below "
    item = lambda: " ".join(rng.choice(words) for _ in range(90))
    items = [(i, opening + item(), " ".join(rng.choice(words) for _ in range(20))) for i in range(7)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    p = [x[1].split() for x in items]
    every_eighth = [w if i % 8 else "changed" for i, w in enumerate(p[2])]
    docs = [
        (1, items[0][1]), (2, noise(50) + " " + " ".join(p[1][20:60]) + " " + noise(700)), (3, " ".join(every_eighth)),
        (4, "<p>" + "</p>\n<p>".join(" ".join(p[3][i : i + 9]) for i in range(0, 98, 9)).upper() + "</p>"),
        (5, opening + noise(90)), (6, noise(30) + " " + " ".join(p[4][30:42]) + noise(30)), (7, "Q: " + items[5][2] + "? " + noise(40)), (8, " ".join(items[5][2].split()[:12]) + " " + noise(40)),
        (9, ""), (10, None), (None, items[0][1]), (11, noise(5) + " " + items[0][1] + " " + items[6][1] + noise(20_000)), (1, items[0][1]),
    ]
    wanted = {(1, 0, "passage"), (2, 1, "passage"), (3, 2, "passage"), (4, 3, "passage"), (7, 5, "question"), (11, 0, "passage"), (11, 6, "passage")}
    assert found(spark, docs, items) == wanted
    assert found(spark, docs, [*items, items[0], (None, "x y z a b c", "q"), (50, None, None), (51, "", "?!")]) == wanted


def test_prefix_filter_loses_nothing(spark):
    rng = random.Random(7)
    rows = [(u, h, h, 40, needed) for u, needed in ((0, 8), (1, 32), (2, 40), (3, 1)) for h in range(u, 400, 10)]
    units = spark.createDataFrame(rows, "unit int, h bigint, check bigint, n int, needed int")
    frequency = spark.createDataFrame([(h, h, rng.randrange(50)) for h in range(0, 400, 3)], "h bigint, check bigint, freq bigint")
    prefix = {}
    for u, h, _ in leaks.prefixes(units, frequency).collect():
        prefix.setdefault(u, set()).add(h)
    for u, needed in ((0, 8), (1, 32), (2, 40), (3, 1)):
        own = [r[1] for r in rows if r[0] == u]
        assert len(prefix[u]) == 40 - needed + 1
        assert all(prefix[u] & set(rng.sample(own, needed)) for _ in range(50))


def test_every_script_keeps_its_words(spark):
    russian = "Старый смотритель маяка обещал мельнику узкий амбар возле семенного склада за медные монеты"
    greek = "Ο γέρος φαροφύλακας υποσχέθηκε στον μυλωνά μια στενή αποθήκη δίπλα στο λιμάνι για χάλκινα νομίσματα"
    chinese = "老灯塔看守人答应磨坊主在种子仓库旁边建一座狭窄的盐仓以换取铜币"
    hindi = "बूढ़े प्रहरी ने चक्की वाले को बीज भंडार के पास एक संकरा खलिहान देने का वादा किया"
    other = ["Этот телефон работает хорошо и батарея держит целый день без подзарядки даже зимой на холоде", "這台手機電池很耐用屏幕也很清楚我每天都用它看書聽音樂非常滿意推薦購買", "यह फ़ोन बहुत अच्छा है और इसकी बैटरी पूरे दिन चलती है मैं इसे रोज़ इस्तेमाल करता हूँ", "Το κινητό δουλεύει καλά και η μπαταρία κρατάει όλη μέρα χωρίς φόρτιση ακόμα και το χειμώνα"]
    items = [(1, russian, "Кто обещал амбар мельнику у старого склада"), (2, greek, None), (3, chinese, None), (4, hindi, None)]
    docs = [(10 + i, t) for i, t in enumerate(other)] + [(1, f"Отзыв: {russian.upper()}."), (2, f"«{greek}»"), (3, f"评论{chinese}。"), (4, hindi), (5, other[0] + " Кто обещал амбар мельнику у старого склада?")]
    assert found(spark, docs, items) == {(1, 1, "passage"), (2, 2, "passage"), (3, 3, "passage"), (4, 4, "passage"), (5, 1, "question")}


def test_short_units_are_whole_word_runs(spark):
    docs = [(1, "So: what is <b>DNA</b>? Nobody knew."), (2, "What DNA is"), (3, "what is dnase"), (4, "dna")]
    assert found(spark, docs, [(1, None, "What is DNA?"), (2, "DNA", None)]) == {(1, 1, "question"), (1, 2, "passage"), (2, 2, "passage"), (4, 2, "passage")}


def test_many_items_take_one_pass(spark, monkeypatch):
    rng = random.Random(9)
    many = vocabulary(rng, 3000)
    items = [(i, " ".join(rng.choice(many) for _ in range(40)), None) for i in range(10_000)]
    docs = [(i, f"see {items[i * 37][1]} end") for i in range(50)] + [(100 + i, " ".join(rng.choice(many) for _ in range(300))) for i in range(50)]
    passes = []
    inner = leaks._hits
    monkeypatch.setattr(leaks, "_hits", lambda *a: passes.append(1) or inner(*a))
    assert found(spark, docs, items) == {(i, i * 37, "passage") for i in range(50)} and len(passes) == 1


def test_encoding_damage_does_not_hide_words():
    assert leaks.words("Échangé <b>à</b> la “fin”") == leaks.words("Ã‰changÃ© Ã\xa0 la 'fin'")


def test_repair_leaves_sound_text_alone():
    sound = "«AQUÍ» «CAFÉ»—dit-il; SEÑ»; naïve Ångström, 5 €, “ok”"
    assert leaks._DAMAGED.sub(leaks._repaired, sound) == sound
    assert leaks.words("Привет всем".encode().decode("latin-1")) == ["привет", "всем"]
    assert leaks.words("a < b and c > d") == ["a", "b", "and", "c", "d"] and leaks.words(f"x<a title='{'y' * 500}'>z") == ["x", "z"]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d e f g", "x")]) == set()
    assert found(spark, [(1, "a b c d e f g")], []) == set()
