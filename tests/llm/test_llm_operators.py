"""Operators for training data on small frames against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cytoplan.llm import clustering, components, cooccurrence, languages, leakage, mixing, quantiles, splits, vectors


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 1


def rank(values, p):
    return sorted(values)[max(1, (len(values) * p + 99) // 100) - 1]


@pytest.mark.parametrize("settle", [64, 0])
def test_percentiles_against_sort(spark, monkeypatch, settle):
    monkeypatch.setattr(quantiles, "SETTLE", settle)
    rng = random.Random(1)
    data = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(500)] + [(None, 7.0)] + [("c", None)] + [("d", 1.0)] * 200
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    ask = [0, 1, 25, 50, 99, 100]
    rounds = []
    got = {(r["k"], r["percent"]): (r["n"], r["value"]) for r in quantiles.percentiles(df, ["k"], "v", ask, rounds).collect()}
    assert 5 <= len(rounds) <= 20 and sum(r[0] for r in rounds) >= 40  # 3,000 values are narrowed by pivots, whatever is sorted in the end
    by = {}
    for k, v in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got == {(k, p): (len(v), rank(v, p)) for k, v in by.items() for p in ask}
    assert quantiles.percentiles(df.limit(0), ["k"], "v", ask).count() == 0


def test_combined_percentiles_keep_their_bound(spark):
    rng = random.Random(2)
    data = [("x", day, rng.lognormvariate(day % 3, 1)) for day in range(8) for _ in range(rng.randrange(50, 900))]
    df = spark.createDataFrame(data, "k string, day int, v double")
    parts = quantiles.percentiles(df, ["k", "day"], "v", list(range(0, 101, 2)))
    values = sorted(v for _, _, v in data)
    for r in quantiles.combine(parts, ["k"], [5, 50, 95]).collect():
        at = (np.searchsorted(values, r["value"], "right")) / len(values)
        assert abs(at - r["percent"] / 100) <= r["rank_error"]


def test_measurements(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert df.filter(quantiles.is_measurement("v")).count() == 2


# 3


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 9), f"v{j:04d}"))[:k]
        out |= {(f"v{i:04d}", f"v{j:04d}") for j in order}
    return out


def test_hadamard_is_orthonormal():
    h = vectors.hadamard(np.eye(64, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(64), atol=1e-5)


@pytest.mark.parametrize("block", [16384, 10])
def test_nearest_recall(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 64)) * 0.25, base[:30] + rng.normal(size=(30, 64)) * 0.3, np.repeat(base[:1], 9, axis=0)])
    data = [(f"v{k:04d}", [float(v) for v in r], k, "z") for k, r in enumerate(x)]
    bad = [("n1", None, 0, "z"), ("n2", [0.0] * 64, 0, "z"), ("n3", [float("nan")] * 64, 0, "z"), ("n4", [1.0] * 3, 0, "z"), (None, [1.0] * 64, 0, "z"), ("v0001", [9.0] * 64, -1, "z")]
    df = spark.createDataFrame(data + bad, "node string, e array<float>, t int, unit string")
    u = vectors.usable_vectors(df, "node", "e", None, ["t"])
    assert u.count() == len(x)
    got = set(rows(vectors.nearest(u, 5, least=0.9), "id", "other"))
    want = brute(np.float32(x).astype(float), 5, 0.9)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    ask = spark.createDataFrame([("v0000",), ("v0070",)], "id string")
    top = vectors.nearest(u, 3, queries=ask, plan=(4, 1, 64)).collect()
    assert {r["id"] for r in top} == {"v0000", "v0070"} and len(top) == 6 and {r["other"] for r in top if r["id"] == "v0000"} == {"v0240", "v0241", "v0242"}
    assert vectors.nearest(u.limit(0), 5).count() == 0


def test_near_copies_keep_their_nearest(spark):
    """Vectors that eight bits (and 32) don't tell apart are compared in full: every one has its true five nearest."""
    rng = np.random.default_rng(8)
    one = rng.normal(size=64)
    x = one + rng.normal(size=(700, 64)) * 0.001
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(700) for j in np.argsort(-s[i])[:5]}
    df = spark.createDataFrame([(f"v{k:04d}", r.tolist()) for k, r in enumerate(u)], "id string, unit array<double>")
    got = set(rows(vectors.nearest(df, 5, least=0.9), "id", "other"))
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_copies_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(9)
    u = rng.normal(size=(60, 64))
    u = np.concatenate([u, np.repeat(u[:1], 120, axis=0)]) / np.linalg.norm(np.concatenate([u, np.repeat(u[:1], 120, axis=0)]), axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{k:04d}", r.tolist()) for k, r in enumerate(u)], "id string, unit array<double>")
    got = rows(vectors.nearest(df, 3, least=0.9), "id", "other")
    want = {f"v{k:04d}": [x for x in ("v0000", "v0060", "v0061", "v0062") if x != f"v{k:04d}"][:3] for k in [0, *range(60, 180)]}
    assert got == sorted(((k, o) for k, os in want.items() for o in os), key=str)


def test_tables_follow_the_number_of_vectors():
    small, large = vectors.tables_for(64, 10_000, 0.9, 0.995, 1.0), vectors.tables_for(64, 10_000_000, 0.9, 0.995, 1.0)
    assert small[1] == 1 and large[1] == 2 and large[0] * large[2] > small[0] * small[2]


# 4


def test_ties_by_key_with_widespread_keys(spark):
    groups = {f"g{k}": {f"own{k}_{n}" for n in range(5)} | {f"all{n}" for n in range(9)} for k in range(8)}
    groups["g0"] |= {f"pair{n}" for n in range(1)}
    groups["g1"] |= {f"pair{n}" for n in range(1)}
    groups["g2"] |= {f"x{n}" for n in range(12)}
    groups["g3"] |= {f"x{n}" for n in range(12)}
    data = [(g, k) for g, ks in groups.items() for k in ks] * 2 + [("g0", None), (None, "x1")]
    want = {(a, b) for a, b in itertools.combinations(sorted(groups), 2) if len(groups[a] & groups[b]) >= 10}
    assert set(rows(splits.ties_by_key(spark.createDataFrame(data, "g string, k string"), "g", "k", 10), "a", "b")) == want == {("g0", "g1"), ("g2", "g3")}


def test_ties_by_place(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 50, (12, 2))
    data = [("a", *map(float, q)) for q in p] + [("b", float(x) + 0.05, float(y) - 0.05) for x, y in p] + [("c", *map(float, q)) for q in p[:9]] + [("d", 1.0, 1.0)] * 20 + [("e", 1.0, 1.05)]
    got = set(rows(splits.ties_by_place(spark.createDataFrame(data, "g string, x double, y double"), "g", "x", "y", 0.1, 10), "a", "b"))
    assert got == {("a", "b"), ("d", "e")}


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 4), (4, 5), (7, 6), (8, 8), (9, None), (2, 1), (2, 1)] + [(k, k + 1) for k in range(20, 60)]
    got = dict(rows(components.components(spark.createDataFrame(e, "a int, b int"), "a", "b"), "node", "component"))
    assert got == {**{k: 1 for k in range(1, 6)}, 6: 6, 7: 6, 8: 8, 9: 9, **{k: 20 for k in range(20, 61)}}
    assert components.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_splits_keep_sets_and_proportions(spark):
    rng = random.Random(5)
    data = [(f"s{k:03d}", rng.choice("abcd") if rng.random() < 0.95 else None) for k in range(300) for _ in range(rng.randrange(5, 60))]
    data += [("s000", "a")] * (len(data) // 2)
    sets = spark.createDataFrame([("s001", "s001"), ("s002", "s001"), ("s003", "s003"), ("s004", "s003")], "node string, component string")
    got = splits.stratified_splits(spark.createDataFrame(data, "g string, l string"), "g", "l", sets, {"train": 0.8, "validation": 0.1, "test": 0.1})
    split = {r["g"]: r["split"] for r in got.collect()}
    assert len(split) == 300 and split["s001"] == split["s002"] and split["s003"] == split["s004"]
    assert split["s000"] == "train"  # a third of all rows, all of label a, whose other rows sit among those of b, c and d
    for label in "bcd":
        n = Counter(split[g] for g, x in data if x == label)
        assert abs(n["test"] / sum(n.values()) - 0.1) < 0.04


def test_rare_labels_keep_their_proportions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK_SETS", 60)
    rng = random.Random(6)
    data = [(f"s{k:03d}", rng.choice("ab")) for k in range(600) for _ in range(rng.randrange(5, 20))] + [(f"s{k:03d}", "rare") for k in range(0, 600, 15) for _ in range(3)]
    none = spark.createDataFrame([], "node string, component string")
    got = {r["g"]: r["split"] for r in splits.stratified_splits(spark.createDataFrame(data, "g string, l string"), "g", "l", none, {"train": 0.5, "validation": 0.25, "test": 0.25}).collect()}
    n = Counter(got[g] for g, x in data if x == "rare")
    assert len(got) == 600 and n == {"train": 60, "validation": 30, "test": 30}
    for label in "ab":
        n = Counter(got[g] for g, x in data if x == label)
        assert abs(n["test"] / sum(n.values()) - 0.25) < 0.03


# 5


def test_density_groups(spark):
    rng = np.random.default_rng(4)
    centres = np.linalg.qr(rng.normal(size=(64, 6)))[0].T
    x, truth = [], []
    for k, n in enumerate((900, 400, 300, 200, 150, 120)):
        x.append(centres[k] * 8 + rng.normal(size=(n, 64)) * 1.2)
        truth += [k] * n
    x = np.concatenate([*x, rng.normal(size=(40, 64)), np.repeat(x[0][:1], 50, axis=0)])
    truth += [-1] * 40 + [0] * 50
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(v) for v in r], truth[k]) for k, r in enumerate(u)], "id int, unit array<double>, label int")
    members, groups = clustering.density_groups(df)
    got = {r["id"]: r["group_id"] for r in members.collect()}
    assert groups.count() == 6
    names = {}
    for k, t in enumerate(truth):
        if t >= 0 and got[k] is not None:
            names.setdefault(t, Counter())[got[k]] += 1
    assert all(max(c.values()) >= 0.99 * sum(c.values()) for c in names.values()) and len({c.most_common(1)[0][0] for c in names.values()}) == 6
    assert sum(got[k] is None for k, t in enumerate(truth) if t < 0) >= 38
    assert clustering.typical_members(members, 3).count() == 18
    held = clustering.against_labels(members, "label")
    assert held.filter("label <> usual and label >= 0").count() == 0
    none, _ = clustering.density_groups(df.limit(0))
    assert none.count() == 0


def test_a_small_group_among_very_many_is_found(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(64, 6)))[0].T
    big = [centres[k] * 8 + rng.normal(size=(40_000, 64)) * 1.2 for k in range(5)]
    x = np.concatenate([*big, centres[5] * 8 + rng.normal(size=(20, 64)) * 0.4]).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"id": pa.array(range(len(u)), pa.int32()), "unit": pa.array(list(u), pa.list_(pa.float32()))}), tmp_path / "u.parquet")
    df = spark.read.parquet(str(tmp_path / "u.parquet"))
    members, groups = clustering.density_groups(df)
    assert groups.count() == 6
    small = {r["group_id"] for r in members.filter("id >= 200000").collect()}
    assert len(small) == 1 and None not in small and members.filter(F.col("group_id") == small.pop()).count() == 20


# 7


@pytest.mark.parametrize("block", [256, 2])
def test_pair_counts(spark, monkeypatch, block):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rng = random.Random(7)
    data = [(b, rng.choice("abcdefg")) for b in range(40) for _ in range(rng.randrange(1, 9))] + [(None, "a"), (1, None), (99, "a")]
    baskets = {}
    for b, i in data:
        if b is not None and i:
            baskets.setdefault(b, set()).add(i)
    want = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(data, "b int, i string")
    pairs = cooccurrence.pair_counts(df, "b", "i")
    assert {(r["item_a"], r["item_b"]): r["n_both"] for r in pairs.collect()} == want
    single = Counter(i for s in baskets.values() for i in s)
    out = cooccurrence.association(pairs, spark.createDataFrame(list(single.items()), "item string, n long"), len(baskets))
    r = out.filter("item_a = 'a' and item_b = 'b'").first()
    assert r["lift"] == pytest.approx(want["a", "b"] * len(baskets) / single["a"] / single["b"]) and r["pmi"] == pytest.approx(math.log(r["lift"]))
    assert cooccurrence.pair_counts(df.limit(0), "b", "i").count() == 0


# 8


PASSAGES = [(1, "Probe LKQ7 bound 87 in 6303 mottled tubules, yet probe ZGQ24 missed every whorled patch beside papillae."), (2, "Team quarry embedded 4415 spindled cords in batch cobalt-4553 and sliced roughly 30 of them overnight."), (3, None), (4, "too short")]


def test_leaks(spark):
    fill = "The lower left corner loses many cells beside the air bubble at full resolution. "
    docs = [
        (1, fill * 3 + PASSAGES[0][1] + fill),
        (2, fill + "PROBE lkq7 bound 87 in\r\n> <b>6303</b> mott​led tub-\nules yet probe ZGQ24 skipped every whorled patch beside papillae" + fill),
        (3, fill + "bound 87 in 6303 mottled tubules, yet" + fill),
        (4, fill + "Team harrow embedded 17 lacunar villi in batch ember-12 and imaged roughly 77 of them overnight. " + fill),
        (5, None),
        (6, ""),
        (7, (fill * 4000) + PASSAGES[1][1] + fill * 100),
        (9, (PASSAGES[1][1] + " ") * 400 + fill * 50 + PASSAGES[0][1]),
        (8, fill + "4415 spindled cords in batch cobalt-4553 and sliced roughly 30 of them" + fill),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("span", F.lit(1))
    i = spark.createDataFrame(PASSAGES, "item_id long, passage string").withColumn("text", F.lit("x"))
    got = leakage.leaked_items(d, "doc_id", "text", i, "item_id", "passage").filter(leakage.is_leak())
    assert rows(got, "doc_id", "item_id") == [(1, 1), (2, 1), (7, 2), (8, 2), (9, 1), (9, 2)]
    assert leakage.leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert leakage.leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def best_score(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = max(0, t[i, j] + (1 if a[i] == b[j] else -1), t[i, j + 1] - 1, t[i + 1, j] - 1)
    return t.max()


def test_alignment_equals_the_common_subsequence_of_its_stretch():
    rng = random.Random(1)
    pairs = [(np.array([rng.randrange(6) for _ in range(rng.randrange(1, 16))]), np.array([rng.randrange(6) for _ in range(rng.randrange(1, 26))])) for _ in range(100)]
    for (a, b), (i, j, k, m, equal) in zip(pairs, leakage.align(*zip(*pairs))):
        assert len(equal) <= lcs(a[i:j].tolist(), b[k:m].tolist()) and (len(equal) > 0) == (best_score(a, b) > 0)
        steps = (j - i - len(equal)) + (m - k - len(equal))  # at most: a slant takes one of each
        assert len(equal) - steps <= best_score(a, b) <= len(equal) - steps / 2
    got = leakage.align([np.array([1, 2, 3, 4, 5])], [np.array([9, 1, 2, 8, 4, 5, 9])])[0]
    assert got[:4] == (0, 5, 1, 6) and got[4].tolist() == [0, 1, 3, 4]


def test_svd_finds_the_row_space(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 30))
    df = spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "idx array<int>, val array<double>")
    basis, values, squares = leakage.randomised_svd(df, 30, 8)
    assert np.isclose(squares, (a * a).sum())
    assert np.allclose(values[:4], np.linalg.svd(a)[1][:4]) and np.allclose(a @ basis[:, :4] @ basis[:, :4].T, a, atol=1e-6)


# 9


def test_tokens_and_long_texts(spark):
    if not __import__("os").path.exists(mixing.TOKENIZER):
        pytest.skip("needs the public tokenizers")
    df = spark.createDataFrame([(1, "a cell"), (2, None), (3, ""), (4, "word " * 60_000)], "id int, text string")
    got = dict(rows(mixing.token_counts(df, "text"), "id", "n_tokens"))
    assert got[1] == 2 and got[2] == got[3] == 0 and 60_000 <= got[4] <= 60_010


def best_flow(patterns, targets, total):
    """Greatest flow by trying all integer splits of small patterns."""
    best = 0
    names = sorted(targets)
    options = []
    for p, t in patterns:
        most = t * max(targets[s][1] for s in p)
        options.append([c for c in itertools.product(*(range(min(t * targets[s][1], most) + 1 if s in p else 1) for s in names)) if sum(c) <= most])
    for combo in itertools.product(*options):
        got = [sum(c[k] for c in combo) for k in range(len(names))]
        if all(g <= math.ceil(targets[s][0] * total) for g, s in zip(got, names)):
            best = max(best, sum(got))
    return best


def test_plan_against_all_flows():
    targets = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 3)}
    patterns = [(("a", "b"), 3), (("b", "c"), 2), (("a",), 1)]
    got = mixing.plan(patterns, targets, 10)
    assert sum(got.values()) == best_flow(patterns, targets, 10)


def test_mix(spark):
    data = [(k, f"k{k}", "a", 10) for k in range(50)] + [(100 + k, f"b{k}", "b", 10) for k in range(5)] + [(200 + k, f"k{k}", "b", 10) for k in range(10)] + [(300, "n", None, 1000), (301, "z", "other", 50), (302, "e", "a", 0)]
    docs = spark.createDataFrame(data, "doc_id long, copy string, source string, n_tokens long").withColumn("share", F.lit(1))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.1, 2), ("c", 0.05, 3)], "source string, target_share double, max_repeats int")
    total = sum(r[3] for r in data)
    chosen, report = mixing.mix(docs, targets, "doc_id", "copy", "source", "n_tokens", overlap=False)
    r = {x["source"]: x for x in report.collect()}
    assert r["a"]["planned"] == math.ceil(0.2 * total) and r["c"]["used"] == 0 and r["b"]["planned"] == math.ceil(0.1 * total)
    assert all(abs(x["used"] - x["planned"]) <= 30 for x in r.values()) and chosen.filter("uses > 2").count() == 0
    assert rows(mixing.short_sources(report), "source") == [("c",)]
    over, _ = mixing.mix(docs, targets, "doc_id", "copy", "source", "n_tokens")
    assert over.groupBy("copy").agg(F.sum("uses").alias("u")).filter("u > 2").count() == 0
    none, empty = mixing.mix(docs.limit(0), targets, "doc_id", "copy", "source", "n_tokens")
    assert none.count() == 0 and {x["used"] for x in empty.collect()} == {0}


# 10


EN = ["The segmentation was written twice and the row count is off.", "Nobody has looked at the label file without a reload.", "Please check whether the outline changes at the outer margin.", "They measured the distance between the centres of the cells."]
DE = ["Die Segmentierung wurde doppelt geschrieben und es fehlen Zeilen.", "Niemand hat die Datei ohne erneutes Laden geprüft.", "Bitte prüfen, ob sich der Umriss am äußeren Rand ändert.", "Sie haben den Abstand zwischen den Mitten der Zellen gemessen."]
ZH = ["没有人在第二轮之后看过这个计数矩阵。", "请检查外侧边缘的轮廓是否改变了。"]


def test_languages(spark):
    rng = random.Random(0)
    data = [(k, " ".join(rng.choice(s) for _ in range(4)), lab) for k, (s, lab) in enumerate([(EN, "en"), (DE, "German"), (ZH, "zh-CN")] * 30)]
    cases = [(1000, EN[0] + " " + DE[1], "en"), (1001, DE[0], "en"), (1002, EN[1], None), (1003, EN[2], "en_US"), (1004, "tile=1 n_cells=4 mpp=0.5\n# 3.9\nTODO: batch seeds", "en"), (1005, None, "en"), (1006, "", None), (1007, ZH[1], "??"), (1008, "#12 @u1: " + DE[2] + "\n\n(shared wall)", "de"), (1009, (DE[3] + " ") * 3000, "nl"), (1010, DE[0] + " Unbekannte Gewebeschnitte wurden nochmals gezählt.", "de")]
    df = spark.createDataFrame(data + cases, "doc_id long, text string, lang string").withColumn("confidence", F.lit(0.5))
    model = languages.fit(df, "doc_id", "text", "lang")
    found = languages.document_languages(languages.language_segments(df, "doc_id", "text", model), "doc_id")
    got = rows(languages.label_problems(df, found, "doc_id", "lang"), "doc_id", "lang")
    assert got == sorted([(1000, "de"), (1000, "en"), (1001, "de"), (1002, "en"), (1007, "zh"), (1009, "de")], key=str)
    assert languages.fit(df.limit(0), "doc_id", "text", "lang") is None
    assert languages.language_segments(df.limit(0), "doc_id", "text", model).count() == 0


def test_label_spellings(spark):
    pairs = [("EN", "en"), ("en-GB", "en"), (" Deutsch ", "de"), ("pt_BR", "pt"), ("unk", None), ("", None), (None, None), ("ko", None)]
    got = spark.createDataFrame(pairs, "l string, w string").select("w", languages.label_language("l").alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_tabs_of_prose_are_no_tables():
    prose = "Probe LKQ7\tbound 87\tin 6303 mottled tubules, yet the probe missed every patch.\nRoughly\t70\tweeks later, the tubules on the plate vanished."
    table = "cell\tarea\twall\nc1\t17\t3.2\nc2\t18\t3.4"
    got = languages.pieces_of([prose, table, None, "", "a\tb\tc"])
    assert got.ends[got.text == 0].tolist() == [True, True] and not (got.text == 1).any() and (got.text == 4).sum() == 1


def test_segments_lie_where_they_say():
    texts = ["  One sentence is here. <b>Another</b> one follows!\n\n> Third?  \n[2025-01-01 10:00] stage=embed rc=0\nlast bit", "中文。又一句！", None, "x"]
    got = languages.pieces_of(texts)
    parts = [texts[t][s : s + n] for t, s, n in zip(got.text, got.start, got.length)]
    assert parts == ["One sentence is here.", "Another</b> one follows!", "> Third?", "last bit", "中文。", "又一句！", "x"]


def test_other_languages_come_from_the_labels(spark):
    finnish = ["Soluja laskettiin tuhansia tiheässä kyhmyssä ilman uutta latausta.", "Kukaan ei ole katsonut tiedostoa toisen kierroksen jälkeen."]
    data = [(k, " ".join(s), lab) for k, (s, lab) in enumerate([(EN, "en"), (finnish, "fi"), (DE, "de")] * 20)] + [(900, finnish[0], "en"), (901, EN[0], "zz")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = languages.fit(df, "doc_id", "text", "lang")
    assert "fi" in model.languages
    found = languages.document_languages(languages.language_segments(df, "doc_id", "text", model), "doc_id")
    got = rows(languages.label_problems(df, found, "doc_id", "lang", model.further), "doc_id", "lang")
    assert (900, "fi") in got and (901, "en") in got and len(got) == 2
