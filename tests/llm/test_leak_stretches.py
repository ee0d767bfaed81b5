import numpy as np

from cytoplan.llm import leakage

LONG = "of 5041 ribbed plexuses exactly 63 ruptured under filter ember another 316 buckled under filter lantern scanner tundra skipped row 8140 so whorled acini numbered 57 through 281 never doubled"
SHORT = "by hour seventy most villi in tray 7884 had doubled whereas mottled nodules from donor pool willow stayed cobbled"
PLAIN = "narrow gauze strips dried beside an open window until late autumn when cold wind finally tore them loose again today"
#: Other passages of SHORT's pattern.
PATTERN = [f"by hour {a} most {b} in tray {c} had {d} whereas {e} {f} from donor pool {g} stayed {h}" for a, b, c, d, e, f, g, h in [("ten", "cords", 12, "drifted", "ochre", "villi", "ember", "hollow"), ("six", "acini", 4711, "vanished", "glassy", "cords", "fjord", "mottled"), ("two", "septa", 815, "thickened", "hollow", "crypts", "cobalt", "ochre")]]
FILL = "nobody has looked at this part of the training batch since the seam was fixed and cleaned "


def found(spark, docs, passages):
    d = spark.createDataFrame(list(enumerate([*docs, *[FILL] * 60], 1)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(passages, 1)), "item_id long, passage string")
    got = leakage.leaked_items(d, "doc_id", "text", i, "item_id", "passage").filter(leakage.is_leak())
    return sorted((r["doc_id"], r["item_id"]) for r in got.collect())


def test_leaks_survive_changed_numbers_and_words(spark):
    docs = [
        # three of six numbers changed in 30 words
        FILL + LONG.replace(" 63 ", " some ").replace("8140", "840").replace(" 281", "").replace("buckled", "approximately") + " " + FILL,
        # the only number of a twelve-word stretch with a typing error, and exchanged
        FILL + "villi in tray 7834 had doubled whereas mottled nodules from donor pool " + FILL,
        FILL + "villi in tray many had doubled whereas mottled nodules from donor pool willow " + FILL,
        # two of twelve words without numbers
        FILL + "strips dried beside some open window until late autumn roughly cold wind " + FILL,
        # another text of the pattern
        FILL + "villi in tray 1305 had thickened whereas ochre nodules from donor pool " + FILL,
        # three of twenty words without numbers
        FILL + PLAIN.replace("gauze", "cloth").replace("late", "early").replace("wind", "rain") + " " + FILL,
        # seven words
        FILL + "exactly 63 ruptured under filter ember another " + FILL,
    ]
    assert found(spark, docs, [LONG, SHORT, PLAIN, *PATTERN]) == [(1, 1), (2, 2), (3, 2), (4, 3), (6, 3)]


def test_wording_that_passages_share_is_no_leak(spark):
    common = "answer with one letter only and give no reason for it because the grader reads nothing else here"
    passages = [f"first a heron stood on seven stones near the weir at dawn {common}", f"{common} while two carts of barley rolled down toward the old harbour mill"]
    docs = [FILL + common + " " + FILL, FILL + passages[0] + " " + FILL, FILL + "else here while two carts of barley rolled down toward the old harbour mill " + FILL]
    assert found(spark, docs, passages) == [(2, 1), (3, 2)]


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = [FILL + p + " " + FILL for p in (LONG, SHORT, PLAIN)]
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    assert found(spark, docs, [LONG, SHORT, PLAIN, LONG]) == [(1, 1), (1, 4), (2, 2), (3, 3)]


def test_words_of_many_texts_are_those_of_each():
    texts = ["Vitr-\n> eous <b>x</b> сell It's 3.5", None, "", "été 中文 a​b", "a\x1eb"]
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in leakage.plain_words(t)}))}
    assert leakage.plain_words(texts[0]) == ["vitreous", "x", "cell", "its", "35"]
    got = leakage.Codes(vocabulary).of_texts(texts)
    assert [x.tolist() for x in got] == [[vocabulary[w] for w in leakage.plain_words(t)] for t in texts]


def test_twelve_word_stretches_with_changes_are_candidates():
    rng = np.random.default_rng(0)
    passages = [rng.choice(600, 40).astype(np.int32) for _ in range(100)]
    rows = np.zeros((100 * 29, 600))
    for r, (p, s) in zip(rows, ((p, s) for p in passages for s in range(29))):
        np.add.at(r, p[s : s + 12], 1)
    basis = np.linalg.svd(rows, full_matrices=False)[2][:256].T
    index = leakage.Index(list(range(100)), passages, [np.ones(40)] * 100, np.ones(600), 1.0, basis)
    for changes, most in ((0, 0), (1, 3), (2, 15)):  # of 300
        texts, at = [], []
        for t in range(300):
            start = int(rng.integers(0, 29))
            part = passages[t % 100][start : start + 12].copy()
            part[rng.choice(12, changes, replace=False)] = 600
            at.append(int(rng.integers(0, 3000)))
            texts.append(np.concatenate([np.full(at[-1], 600), part, np.full(int(rng.integers(0, 40)), 600)]))
        hit = {t for t, k, i, j in index.candidates(texts) if k == t % 100 and i <= at[t] < j}
        assert 300 - len(hit) <= most
