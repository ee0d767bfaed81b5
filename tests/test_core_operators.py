"""Core operators on small frames: defined results for nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.functions import equations as eq
from cytoplan.functions import geometry as ge
from cytoplan.functions.strings import slug, slug_text
from cytoplan.operators import alignment as al
from cytoplan.operators import batching as ba
from cytoplan.operators import graph as gr
from cytoplan.operators import images as im
from cytoplan.operators import model as mo
from cytoplan.operators import vector_quality as vq
from cytoplan.operators.proximity import locate_in_regions, neighbours_within, trapezoids_of_ring
from cytoplan.operators.references import orphan_references, orphan_report


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def day(n):
    return dt.datetime(2025, 1, n)


REC = "s string, c string, born timestamp, died timestamp, n int"
REF = "id int, s string, c string, at timestamp, n int"


@pytest.fixture
def records(spark):
    return spark.createDataFrame([("a", "x", day(5), None, 1), ("a", "x", day(9), None, 2), ("a", "y", day(1), day(4), 1), ("b", None, day(1), None, 1), (None, "q", day(1), None, 1)], REC)


@pytest.fixture
def refs(spark):
    data = [(1, "a", "x", day(5), 0), (2, "a", "x", day(4), 0), (3, "a", "y", day(3), 0), (4, "a", "y", day(4), 0), (5, "b", None, day(2), 0), (6, None, "x", day(8), 0), (7, None, None, day(8), 0), (8, "a", "z", day(9), 0), (8, "a", "z", day(9), 0), (9, "a", "x", None, 0), (10, None, "zz", day(9), 0)]
    return spark.createDataFrame(data, REF)


def orphans(refs, records, match):
    return [r["id"] for r in orphan_references(refs, records, {"s": "s", "c": "c"}, "at", "born", "died", match).orderBy("id").collect()]


def test_orphans_by_match(refs, records):
    assert orphans(refs, records, "simple") == [2, 4, 8, 8, 9]
    assert orphans(refs, records, "full") == [2, 4, 5, 6, 8, 8, 9, 10]
    assert orphans(refs, records, "partial") == [2, 4, 8, 8, 9, 10]  # the row of 5 names a slide with a live record, 6 a live cell
    with pytest.raises(ValueError):
        orphan_references(refs, records, {"s": "s"}, match="none")


def test_orphans_without_time_and_of_empty_tables(refs, records):
    plain = orphan_references(refs, records, {"s": "s", "c": "c"})
    assert [r["id"] for r in plain.orderBy("id").collect()] == [8, 8]
    assert orphan_references(refs.limit(0), records, {"s": "s", "c": "c"}).count() == 0
    assert orphan_references(refs, records.limit(0), {"s": "s", "c": "c"}).count() == 7
    assert plain.columns == refs.columns
    assert rows(orphan_report(plain, "at"), "month", "n_orphans") == [("2025-01", 2)]


def test_orphans_of_a_hot_key(spark):
    refs = spark.range(6000).select(F.lit("a").alias("s"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"), F.col("id"))
    records = spark.range(0, 6000, 2).select(F.lit("a").alias("s"), F.col("id").cast("string").alias("c"))
    want = [i for i in range(6000) if i % 3 == 0 or i % 2 == 1]
    assert [r["id"] for r in orphan_references(refs, records, {"s": "s", "c": "c"}).orderBy("id").collect()] == want


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    p = [(f"s{k % 3}", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-150, 150, (900, 2)))]
    p += [("s0", 1000, 10.0, 10.0), ("s0", 1001, 10.0, 10.0), ("s0", 1001, 10.0, 10.0), ("s0", 1002, 14.0, 10.0), ("s1", 1003, 10.0, 10.0)]
    p += [("s0", 1004, None, 1.0), ("s0", 1005, float("nan"), 1.0), ("s0", 1006, 0.0, 0.0), (None, 1007, 10.0, 10.0), ("s0", None, 10.0, 10.0), ("s0", 1008, float("inf"), 1.0)]
    got = neighbours_within(spark.createDataFrame(p, "space string, a long, x double, y double"), "space", "a", "x", "y", 4.0)
    ok = [(s, i, x, y) for s, i, x, y in p if s and i is not None and x is not None and math.isfinite(x) and (x, y) != (0, 0)]
    want = {(s, i, j) for s, i, x, y in ok for t, j, u, v in ok if s == t and i < j and math.hypot(x - u, y - v) <= 4}
    assert {(r["space"], r["a"], r["b"]) for r in got.collect()} == want and ("s0", 1000, 1002) in want
    assert neighbours_within(spark.createDataFrame([], "s string, i long, x double, y double"), "s", "i", "x", "y", 1.0).count() == 0


def test_points_in_regions_against_even_odd(spark):
    rng = np.random.default_rng(2)
    star = [(10 + (5 + 4 * (k % 2)) * math.cos(k * math.pi / 5), 10 + (5 + 4 * (k % 2)) * math.sin(k * math.pi / 5)) for k in range(10)]
    regions = [("a", 1, star), ("a", 2, [(0, 0), (20, 0), (20, 5)]), ("b", 3, star), ("a", 4, [(0, 0), (1, 1)]), ("a", 5, None)]
    pts = [("a" if k % 2 else "b", k + (1 << 60), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-2, 22, (800, 2)))] + [("a", 7, None, 1.0)]
    reg = spark.createDataFrame([(s, r, [(float(x), float(y)) for x, y in g] if g else None) for s, r, g in regions], "s string, region long, ring array<struct<x:double,y:double>>")
    got = {(r["id"], r["region"]) for r in locate_in_regions(spark.createDataFrame(pts, "s string, id long, x double, y double"), reg, "s", "id", "x", "y", "region", "ring", 4.0).collect()}
    want = {(i, r) for s, i, x, y in pts if x is not None for t, r, g in regions if s == t and g and len(g) > 2 and ge.contains(np.array(g, float), np.array([x]), np.array([y]))[0]}
    assert got == want and len(want) > 100


def test_trapezoids_cover_the_area():
    v = np.array([[0, 0], [7, 1], [5, 6], [3, 2], [1, 5]], float)
    t = trapezoids_of_ring(v[:, 0], v[:, 1], 2.0)
    assert sum((b - a) * ((h - lo) + (k - m)) / 2 for a, b, lo, m, h, k in t) == pytest.approx(abs(ge.area(v)))


def path_graph(spark, n, far=None):
    e = [(k, k + 1, 1.0, 100.0 if k == far else 10.0) for k in range(n - 1)]
    return spark.createDataFrame(e, "i long, j long, shared_wall_um double, centroid_dist_um double"), spark.range(n).select(F.col("id").alias("cell_ix"), (F.col("id") % 2).cast("string").alias("type"))


def test_prune_degrees_and_isolated(spark):
    e, c = path_graph(spark, 6, far=2)
    kept, lost = gr.prune(e, "centroid_dist_um")
    assert kept.count() == 4 and rows(lost, "dst", "n_pruned") == [(2, 1), (3, 1)]
    assert [r["degree"] for r in gr.degrees(c, "cell_ix", kept).orderBy("cell_ix").collect()] == [1, 2, 1, 1, 2, 1]
    assert [r["degree"] for r in gr.degrees(c, "cell_ix", e.limit(0)).collect()] == [0] * 6


def test_niche_composition_and_weights(spark):
    e, c = path_graph(spark, 4)
    n = gr.niche(e, c, "cell_ix", "type")
    assert rows(n.filter("dst < 2"), "dst", "type", "share") == [(0, "1", 1.0), (1, "0", 1.0)]
    assert rows(gr.composition(n, c, "cell_ix", "type"), "type", "neighbour_type", "share", "support") == [("0", "1", 1.0, 2), ("1", "0", 1.0, 2)]
    beta = gr.smoothing_weights(e, "shared_wall_um", "centroid_dist_um")
    assert all(abs(r["s"] - 1) < 1e-9 for r in beta.groupBy("dst").agg(F.sum("beta").alias("s")).collect())
    flat = gr.smoothing_weights(e.withColumn("shared_wall_um", F.lit(0.0)), "shared_wall_um", "centroid_dist_um")
    assert {r["beta"] for r in flat.collect()} == {0.0}


def test_rings_on_a_path(spark):
    e, _ = path_graph(spark, 6)
    s = spark.createDataFrame([(1, 0), (2, 2), (2, 3), (2, 3), (3, None)], "g int, id long")
    assert rows(gr.rings(e, s, "g", "id"), "g", "id", "ring") == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 2), (2, 1, 1), (2, 2, 0), (2, 3, 0), (2, 4, 1), (2, 5, 2)]
    nodes, edges = mo.tile_batch(path_graph(spark, 8)[0], spark.createDataFrame([(0, 3), (0, 4)], "t int, id long"), "t", "id")
    assert [r["id"] for r in nodes.orderBy("local_ix").collect()] == [3, 4, 2, 5, 1, 6]
    assert rows(edges.filter("leak"), "src_ix", "dst_ix") == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_voronoi_edges_of_a_lattice(spark):
    pts = [("s", 10 * i + j, 12.0 * i, 12.0 * j + (0.3 * i)) for i in range(6) for j in range(6)] + [("s", 99, 0.0, 0.0), ("s", 100, float("nan"), 1.0)]
    e = gr.voronoi_edges(spark.createDataFrame(pts, "s string, id long, x double, y double"), "s", "id", "x", "y")
    near = {(r["i"], r["j"]): r["face"] for r in e.collect()}
    assert near[(11, 12)] == pytest.approx(12, abs=0.5) and (11, 33) not in near and not any(99 in k for k in near)
    far = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 20.0, 0.0)], "s string, id long, x double, y double")
    assert gr.voronoi_edges(far, "s", "id", "x", "y").collect()[0]["face"] == pytest.approx(2 * math.sqrt(900 - 100))


def test_alignment(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ix int, k string")
    other = spark.createDataFrame([("a", 5, 9), ("a", 4, 8), (None, 1, 1)], "k string, o int, ix int")
    assert rows(al.left_attach(cells, other, ["k"], ["o"], "found"), "ix", "o", "found") == [(1, 4, True), (2, None, False), (3, None, False)]
    lab = spark.createDataFrame([(None,), ("UNASSIGNED ",), (" ",), ("B",)], "l string").select(al.folded_label("l").alias("l"))
    assert [r["l"] for r in lab.collect()] == ["Unassigned"] * 3 + ["B"]
    with pytest.raises(ValueError):
        al.centre_and_mask(cells, spark.createDataFrame([("zz", [1.0])], "k string, v array<float>"), "k", "v", 1)


def test_slug(spark):
    names = ["/data/My Slide_XRrun_outs.zip", "x/A-b/outs", "lung.tar.gz", "__"]
    got = [r["s"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(slug("n").alias("s")).collect()]
    assert got == ["my_slide", "a_b", "lung", None] and [slug_text(n) for n in names[:3]] == got[:3]
    with pytest.raises(ValueError):
        slug_text("__")


def test_epoch_covers_each_cell_once(spark):
    b = ba.epoch_batches(spark.range(1000).select(F.col("id").alias("c")), "c", 64)
    assert b.count() == 1000 == b.select("c").distinct().count() and b.select("batch_id").distinct().count() == 16
    assert ba.epoch_batches(spark.range(1000).select(F.col("id").alias("c")), "c", 64, drop_last=True).count() == 960


def test_tiles_partition_the_points(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([("s", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1000, (1500, 2)))], "s string, id long, x double, y double")
    sizes = [r["count"] for r in ba.spatial_tiles(p, "s", "id", "x", "y", 200).groupBy("tile").count().collect()]
    assert sum(sizes) == 1500 and all(100 < n <= 200 for n in sizes)


def test_geometry_kernels():
    sq = lambda x, y, s=1.0: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]])
    assert ge.distance(sq(0, 0), sq(3, 0)) == 2 and ge.distance(sq(0, 0), sq(0.5, 0.5)) == 0 and ge.distance(sq(0, 0, 9), sq(3, 3)) == 0
    assert ge.shared_boundary(sq(0, 0), sq(1, 0.25)) == pytest.approx(0.75) and ge.shared_boundary(sq(0, 0), sq(2, 0)) == 0
    assert ge.apposed_wall(sq(0, 0), sq(1.5, 0), 1.0) == pytest.approx(2.0)
    bow = ge.simple_part(np.array([[0, 0], [4, 4], [4, 0], [0, 2]], float))
    assert len(bow) == 3 and ge.simple_part(sq(0, 0)) is not None and ge.simple_part(np.array([[0, 0], [1, 1], [2, 2]], float)) is None
    assert (ge.from_wkb(ge.to_wkb(sq(2, 3))) == ge.ring(*sq(2, 3).T)).all() and ge.from_wkb(b"x") is None
    v = np.array([[0, 0], [4, 0], [4, 1], [1, 1], [1, 4], [0, 4]], float)
    assert ge.contains(v, *(np.array([c]) for c in ge.representative_point(v)))[0]
    m = ge.measures(v, 0.5)
    assert m[0] == pytest.approx(7 * 0.25) and m[1] == pytest.approx(16 * 0.5) and m[6] == pytest.approx(7 / 11.5)
    assert abs((~ge.disk_mask(256, 25.0, 128.0)).mean() - math.pi * 625 / 128**2) < 2e-3
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 4, (5, 2)), rng.uniform(2, 7, (5, 2))
    a, b = ge.hull(a), ge.hull(b)
    t = np.linspace(0, 1, 4000, endpoint=False)
    pts = np.concatenate([p + t[:, None] * (q - p) for p, q in zip(a, np.roll(a, -1, 0))])
    near = ge.contains(b, pts[:, 0], pts[:, 1]) | (ge._point_segment(pts, b, np.roll(b, -1, 0)).min(1) <= 0.7)
    w = np.concatenate([np.full(4000, np.hypot(*(q - p)) / 4000) for p, q in zip(a, np.roll(a, -1, 0))])
    assert ge._covered(a, b, 0.7) == pytest.approx((near * w).sum(), abs=0.01)


def test_equations(spark):
    assert (eq.shrink_to_diagonal(np.array([[2.0, 1], [1, 3]]), 0.4) == np.array([[2, 0.6], [0.6, 3]])).all()
    beta = spark.createDataFrame([(0, 1, 0.25), (0, 2, 0.75)], "dst int, src int, beta double")
    rho = spark.createDataFrame([(1, "b", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "id int, g string, v double")
    assert rows(eq.foreign_influx(beta, rho, "id", "g", "v"), "gene", "influx") == [("a", 0.375), ("b", 0.625)]
    with pytest.raises(ValueError):
        eq.leakage_mix(F.lit(1), F.lit(1), 1.0, ["c"])
    rng = np.random.default_rng(0)
    z = rng.normal(size=(100_000, 2))
    v = 0.8 * z[:, :1] + 0.6 * rng.normal(size=(100_000, 1))
    for coupled, x in ((True, np.hstack([z, v])), (False, np.hstack([z, rng.normal(size=(100_000, 1))]))):
        t = eq.TypeCovariances(2, 1, shrink=0.0)
        t.update({"a": (len(x), x.mean(0), x.T @ x / len(x))})
        assert t.penalty()[0] == pytest.approx(-0.5 * math.log(1 - 0.64) if coupled else 0, abs=5e-3)


def test_attention_sums_to_one():
    rng = np.random.default_rng(1)
    h, src, dst = rng.normal(size=(6, 5)), np.array([0, 1, 2, 3, 4, 5]), np.array([0, 0, 1, 1, 1, 0])
    out, alpha = mo.gat(h, rng.normal(size=(3, 4)), src, dst, rng.normal(size=(5, 2, 3)), rng.normal(size=(4, 2, 3)), rng.normal(size=(2, 3)))
    assert np.allclose([alpha[dst == k].sum(0) for k in (0, 1)], 1) and (out[2] == 0).all()


SMALL = {"z": 4, "w": 2, "hidden": 16, "type": 4, "gat": 6, "heads": 4}


def tiny_tile(genes=30, types=3, image=5):
    """Seeds 3, 4 and 7 of a path of eight cells whose last edge is pruned: nodes 3, 4, 7, then 2, 5, then 1, 6."""
    rng = np.random.default_rng(0)
    nodes = [3, 4, 7, 2, 5, 1, 6]
    at = {c: k for k, c in enumerate(nodes)}
    into = [(s, d) for d in (3, 4, 2, 5) for s in (d - 1, d + 1)]
    e = np.array([(at[s], at[d]) for s, d in into]).T
    leak = e[:, e[1] < 3]
    return dict(x=rng.poisson(2.0, (7, genes)).astype(float), kind=rng.integers(0, types, 7), image=rng.normal(size=(7, image)), isolated=np.array([c == 7 for c in nodes]), seeds=3, ring1=2, gat_edges=(e[0], e[1]), leak=(leak[0], leak[1], np.full(leak.shape[1], 0.5)))


def test_forward_pass_shapes_and_the_isolated_seed():
    p, tile = mo.random_weights(30, 3, 5, sizes=SMALL), tiny_tile()
    f = mo.tile_forward(p, **tile, kappa=0.2, rng=np.random.default_rng(1))
    assert f["z"].shape == (7, 4) and f["context"].shape == (5, 12) and f["w"].shape == (5, 2) and f["log_p"].shape == f["log_p_prior"].shape == (3, 30)
    assert all(np.isfinite(v).all() for v in f.values())
    assert (f["context"][2, :6] == 0).all() and f["context"][2, -1] == 1 and (f["influx"][2] == 0).all() and np.allclose(f["context"][:, 6:11], tile["image"][:5])
    assert np.allclose(np.exp(f["log_p"]).sum(1), 1) and np.allclose(f["log_p"][2], f["log_rho"][2])
    # the decoder and the influx don't see the type but through z and w; the image reaches the context only
    other = mo.tile_forward(p, **(tile | {"image": tile["image"] + 1}), kappa=0.2, rng=np.random.default_rng(1))
    assert np.allclose(other["z"], f["z"]) and not np.allclose(other["prior_w"], f["prior_w"])


@pytest.mark.parametrize("kappa,omega", [(0.0, 0.0), (0.0, 1.0), (0.3, 1.0)])
def test_loss_equals_the_sum_written_out(kappa, omega):
    p, tile = mo.random_weights(30, 3, 5, sizes=SMALL), tiny_tile()
    f = mo.tile_forward(p, **tile, kappa=kappa, rng=np.random.default_rng(2))
    total = 0.0
    for s in range(3):
        x, one = tile["x"][s], 0.0
        for name, weight in (("log_p", 1.0), ("log_p_prior", omega)):
            one += weight * sum(a * b for a, b in zip(x, f[name][s])) / max(1, sum(x))
        one -= (1 + omega) * sum(0.5 * (math.exp(v) + m * m - 1 - v) for m, v in zip(f["mu_z"][s], f["logvar_z"][s]))
        one -= sum(0.5 * (math.exp(v) + (m - q) ** 2 - 1 - v) for m, v, q in zip(f["mu_w"][s], f["logvar_w"][s], f["prior_w"][s]))
        total += one
    assert mo.loss_terms(f, tile["x"][:3], omega=omega)["loss"] == pytest.approx(-total / 3, rel=1e-9)
    assert mo.loss({"recon_a": -1.0, "recon_b": -2.0, "kl_z": 0.5, "kl_w": 0.25}) == pytest.approx(4.25)
    # the influx of the posterior draw stands in both mixtures
    rho = np.exp(f["log_rho"])
    assert np.allclose(f["influx"][0], 0.5 * rho[3] + 0.5 * rho[1])


def test_tiles_run_in_tasks_of_their_own(spark):
    p, tile = mo.random_weights(30, 3, 5, sizes=SMALL), tiny_tile()
    nodes = [(t, k, 0 if k < 3 else 1 if k < 5 else 2, tile["x"][k].tolist(), int(tile["kind"][k]), tile["image"][k].tolist(), bool(tile["isolated"][k])) for t in (1, 2) for k in range(7)]
    edges = [(t, int(s), int(d), bool(d < 3), 0.5) for t in (1, 2) for s, d in zip(*tile["gat_edges"])]
    n = spark.createDataFrame(nodes, "tile long, local_ix int, ring int, counts array<double>, type int, image array<double>, isolated boolean")
    e = spark.createDataFrame(edges, "tile long, src_ix int, dst_ix int, leak boolean, beta double")
    got = {r["tile"]: r for r in mo.tile_losses(n, e, p, 0.2).collect()}
    f = mo.tile_forward(p, **tile, kappa=0.2, rng=np.random.default_rng([0, *b"1"]))
    assert set(got) == {1, 2} and got[1]["n_seeds"] == 3 and got[1]["loss"] == pytest.approx(mo.loss_terms(f, tile["x"][:3])["loss"]) and got[1]["loss"] != got[2]["loss"]


def test_edge_gates():
    rng = np.random.default_rng(3)
    h, src, dst, v = rng.normal(size=(4, 5)), np.array([1, 2, 0]), np.array([0, 0, 1]), rng.normal(size=(3, 2))
    layer = ((rng.normal(size=(5, 5)), rng.normal(size=5)), [(rng.normal(size=(2, 16)), np.zeros(16)), (rng.normal(size=(16, 1)), np.zeros(1))], (rng.normal(size=(10, 5)), rng.normal(size=5)))
    out = mo.edge_gated_layer(h, src, dst, v, *layer)
    gate = [1 / (1 + math.exp(-float(mo.mlp(layer[1], v[k : k + 1])[0, 0]))) for k in range(3)]
    sent = h @ layer[0][0] + layer[0][1]
    mean = (sent[1] * gate[0] + sent[2] * gate[1]) / 2
    assert np.allclose(out[0], np.maximum(np.concatenate([h[0], mean]) @ layer[2][0] + layer[2][1], 0))
    assert np.allclose(out[3], np.maximum(np.concatenate([h[3], np.zeros(5)]) @ layer[2][0] + layer[2][1], 0))
    parts = {"encode": (rng.normal(size=(7, 5)), np.zeros(5)), "layers": [layer], "image": (rng.normal(size=(6, 5)), np.zeros(5)), "head": (rng.normal(size=(10, 3)), np.zeros(3))}
    assert mo.type_logits(parts, rng.poisson(2, (4, 7)), np.array([0, 2]), src, dst, v, rng.normal(size=(2, 6))).shape == (2, 3)


def test_moving_support():
    rng = np.random.default_rng(0)
    rows_ = lambda n: (n, (x := rng.normal(size=(n, 3))).mean(0), x.T @ x / n)
    t = eq.TypeCovariances(2, 1, rate=0.1, least=25.0)
    t.update({"a": rows_(40), "b": rows_(3)})
    assert t.support("a") == pytest.approx(40) and t.support("b") == pytest.approx(3) and t.penalty()[1] == pytest.approx(3 / 43)
    for _ in range(30):
        t.update({"b": rows_(30)})
    assert t.support("b") > 25 and t.penalty()[1] == 0 and t.penalty({"b": 0.0})[0] == 0


def test_simulation(spark):
    df, edges = mo.simulate(spark, 300)
    cells = df.collect()
    a = [tuple(map(str, r)) for r in df.orderBy("cell_ix").collect()]
    assert a == [tuple(map(str, r)) for r in mo.simulate(spark, 300)[0].repartition(7).orderBy("cell_ix").collect()]
    assert all(sum(r["counts"]) == r["total"] >= 20 and abs(sum(r["p"]) - 1) < 1e-9 and abs(sum(r["rho"]) - 1) < 1e-9 for r in cells)
    by = {r["cell_ix"]: r for r in cells}
    links = edges.collect()
    assert all(e["distance"] <= 40 for e in links)
    alone = set(by) - {e[k] for e in links for k in "ij"}
    assert all(by[c]["p"] == by[c]["rho"] and len(by[c]["y_niche"]) == 0 for c in alone)
    same = np.mean([by[e["i"]]["type"] == by[e["j"]]["type"] for e in links])
    assert same > 1.3 * sum((np.mean([r["type"] == t for r in cells])) ** 2 for t in range(4))  # types cluster in space
    one = next(c for c in by if c not in alone)
    near = [(e["j"] if e["i"] == one else e["i"], math.exp(-e["distance"] / 20)) for e in links if one in (e["i"], e["j"])]
    mix = 0.8 * np.array(by[one]["rho"]) + 0.2 * sum(w * np.array(by[k]["rho"]) for k, w in near) / sum(w for _, w in near)
    assert np.allclose(mix, by[one]["p"])


def test_crops(spark):
    tiles = spark.createDataFrame([(0, "c", ty, tx, [float(100 * (4 * ty + y) + 4 * tx + x) for y in range(4) for x in range(4)]) for ty in range(3) for tx in range(3)], "level int, channel string, ty int, tx int, pixels array<double>")
    cells = spark.createDataFrame([("in", 6.0, 6.0), ("edge", 0.0, 0.0), ("out", 500.0, 5.0), (None, 1.0, 1.0)], "cell_id string, x double, y double")
    got = {r["cell_id"]: np.array(r["pixels"]).reshape(4, 4) for r in im.crop_cells(tiles, cells, 4, 1.0, half_um=2.0, out=4, outside="drop").collect()}
    with pytest.raises(Exception, match="outside the image"):
        im.crop_cells(tiles, cells, 4, 1.0, half_um=2.0, out=4).collect()
    by_block = {r["cell_id"]: np.array(r["pixels"]).reshape(4, 4) for r in im.crop_cells(tiles, cells, 4, 1.0, half_um=2.0, out=4, block=3, outside="drop").collect()}
    assert all((by_block[k] == got[k]).all() for k in got)
    assert set(got) == {"in", "edge"} and got["in"][0, 0] == 404 and got["edge"][0, 0] == 0 and got["edge"][3, 3] == 101
    assert (im.read_window(tiles, 0, 4, 4, 8, 8, 4)[..., 0][0] == [404, 405, 406, 407]).all()


def test_display_stretch_and_colours():
    assert im.display_stretch(np.full((4, 4), 7.0)).max() == 0 and im.display_stretch(np.arange(100.0).reshape(10, 10))[-1, -1] == 1
    planes = np.zeros((2, 2, 4))
    planes[0, 0] = [0.5, 0.1, 0.0, 1.0]
    assert np.allclose(im.display_rgb(planes)[0, 0], [0.9, 0.5, 0.4]) and np.allclose(im.display_rgb(planes[..., :1])[0, 0], 0.5)


def test_medians_by_counts_of_ranges(spark, monkeypatch):
    from cytoplan.operators import batching as ba

    monkeypatch.setattr(ba, "MEDIAN_ROWS", 20)
    monkeypatch.setattr(ba, "MEDIAN_RANGES", 8)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.lognormal(size=501), np.full(400, 1.5)])
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)] + [(9999, None)], "id int, v double")
    assert ba.exact_median(df, "v", "id") == pytest.approx(float(np.median(v))) and ba.exact_median(df.limit(0), "v", "id") is None
    assert ba.exact_median(df.filter("id < 500"), "v", "id") == pytest.approx(float(np.median(v[:500])))


def test_scores_of_separable_vectors(spark):
    from cytoplan.operators import scoring as sc

    rng = np.random.default_rng(2)
    data = [(k, (np.eye(4)[k % 3] * 4 + rng.normal(size=4)).tolist(), "abc"[k % 3]) for k in range(240)] + [(900, [0.0] * 4, None), (901, None, "a")]
    df = spark.createDataFrame(data, "id int, v array<double>, label string")
    r = sc.logistic_scores(df.filter("id % 4 > 0"), df.filter("id % 4 = 0").unionByName(spark.createDataFrame([(990, [1.0] * 4, "unseen")], df.schema)), "id", "v", "label").first()
    assert r["auc"] > 0.97 and r["accuracy"] > 0.85 and (r["n_train"], r["n_test"], r["n_classes"]) == (180, 60, 3)


def test_separation_of_many_rows_takes_a_sample(spark):
    rng = np.random.default_rng(4)
    x = np.eye(8)[np.arange(400) % 4] * 3 + rng.normal(size=(400, 8)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, k % 4, r.tolist()) for k, r in enumerate(x)], "id long, label int, unit array<double>")
    all_, few = vq.separation_report(df, "id", "label").first(), vq.separation_report(df, "id", "label", most=100).first()
    assert few["mean_same"] == pytest.approx(all_["mean_same"]) and few["n"] == 400 and few["agreement"] == pytest.approx(all_["agreement"], abs=0.1)
    s = x @ x.T
    same = np.equal.outer(np.arange(400) % 4, np.arange(400) % 4) & ~np.eye(400, dtype=bool)
    assert all_["mean_same"] == pytest.approx(s[same].mean()) and all_["mean_other"] == pytest.approx(s[~same & ~np.eye(400, dtype=bool)].mean())


def test_a_bundle_is_served(spark, tmp_path):
    from cytoplan.plans.dataset import open_dataset
    from cytoplan.sources import catalog

    cells = spark.createDataFrame([(f"c{k}", float(k), 0.0, "AB"[k % 2] if k else None) for k in range(6)], "cell_id string, x_um double, y_um double, cell_group string")
    links = spark.createDataFrame([(f"c{k}", f"c{k + 1}", 1.0, 10.0) for k in range(5)], "i string, j string, shared_wall_um double, centroid_dist_um double")
    catalog.save_bundle({"cells": cells, "edges_voronoi": links}, catalog.dataset(str(tmp_path), "One slide"), "default")
    vectors = spark.createDataFrame([("c1", [1.0] * 64)], "cell_id string, image_embedding array<float>")
    g = open_dataset(spark, str(tmp_path), vectors=vectors)
    assert g.length(4) == 2 and g.types.count() == 3 and {r["edge_id"] for r in g.edges.collect()} == set(range(5))
    batch = g.batches(4)
    assert batch.seeds.count() == 6 and batch.seeds.filter("found").count() == 1 and batch.nodes.filter("not is_seed and found is not null").count() == 0
    assert batch.edges.count() == 10 and batch.edges.filter("beta is null or edge_id is null").count() == 0
    with pytest.raises(ValueError):
        open_dataset(spark, str(tmp_path), graph="contact")
