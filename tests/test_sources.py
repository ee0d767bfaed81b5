"""Sources, catalog, pipeline and streams by round trips."""

import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.plans.cell_graph import slide_tables
from cytoplan.plans.pipeline import Run
from cytoplan.sources import catalog, slides
from cytoplan.streaming import ingest


def hexagons(spark, n=5):
    rows = []
    for i in range(n):
        for j in range(n):
            for k in range(6):
                rows.append((f"c{i}{j}", k, 12.0 * i + (6 if j % 2 else 0) + 5.8 * np.cos(k * np.pi / 3 + 0.5), 10.4 * j + 5.8 * np.sin(k * np.pi / 3 + 0.5)))
    return spark.createDataFrame([(c, k, float(x), float(y)) for c, k, x, y in rows], "cell_id string, vertex_ix int, vertex_x double, vertex_y double")


def test_export_to_bundle(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    hexagons(spark).coalesce(1).write.parquet(f"file://{tmp_path}/b")
    part = next((tmp_path / "b").glob("*.parquet"))
    with zipfile.ZipFile(raw / "slide_outs.zip", "w") as z:
        z.write(part, "outs/cell_boundaries.parquet")
        z.writestr("outs/experiment.xenium", json.dumps({"pixel_size": 0.5}))
        z.writestr("outs/other.txt", "no")
    at = slides.locate_export(str(raw))
    assert slides.read_experiment(str(at)) == {"pixel_size": 0.5} and not (at / "other.txt").exists() and slides.locate_export(str(raw)) == at
    out = slides.read_outlines(spark, f"file://{at}/cell_boundaries.parquet", 0.5)
    assert out.count() == 25 and len(out.first()["xs"]) == 6
    labels = spark.createDataFrame([("c00", "T"), ("c00", "B"), ("c01", None)], "cell_id string, group string")
    tables = slide_tables(out, 0.5, labels)
    data = catalog.dataset(str(tmp_path / "wh"), "My Slide.zip")
    catalog.save_bundle(tables, data, "default", microns_per_pixel=0.5)
    back = catalog.load_bundle(spark, data)
    assert back["cells"].count() == 25 and {r["cell_group"] for r in back["cells"].collect()} <= {"T", "B", "Unassigned"}
    assert back["edges_voronoi"].count() > 40 and back["edges_contact"].filter("wall_dist_um > 1").count() == 0
    ring = back["polygons"].select(slides_ring()).first()[0]
    assert len(ring) == 6
    assert catalog.resolve_bundle(str(tmp_path / "wh"), None)[0].name == "my_slide" and "my_slide: default" in catalog.describe(str(tmp_path / "wh"))
    assert data.manifest()["bundles"]["default"]["microns_per_pixel"] == 0.5
    with pytest.raises(ValueError):
        data.bundle("a/b")


def slides_ring():
    from cytoplan.functions.geometry import rings_from_wkb

    return rings_from_wkb("wkb")["xs"]


def test_csv_inputs(spark, tmp_path):
    assert slides.read_cell_groups(spark, str(tmp_path)) is None
    (tmp_path / "x_cell_groups.csv").write_text("cell_id,group,color\na,T,#fff\n")
    assert slides.read_cell_groups(spark, str(tmp_path)).first()["group"] == "T"
    (tmp_path / "b_gene_groups.csv").write_text("gene,group\ng,z\ng,a\n")
    assert slides.first_gene_group(slides.read_gene_groups(spark, str(tmp_path)), "gene", "group", "row_ix").first()["gene_group"] == "z"
    (tmp_path / "a_gene_groups.csv").write_text("gene\ng\n")
    with pytest.raises(ValueError):
        slides.read_gene_groups(spark, str(tmp_path))
    inner = tmp_path / "analysis/clustering/gene_expression_graphclust"
    inner.mkdir(parents=True)
    (inner / "clusters.csv").write_text("Barcode,Cluster\na,3\n")
    assert tuple(slides.read_clusters(spark, str(tmp_path)).first()) == ("graphclust", "a", 3)
    with tarfile.open(tmp_path / "analysis.tar.gz", "w:gz") as t:
        t.add(tmp_path / "analysis", "analysis")
    assert tuple(slides.read_clusters(spark, str(tmp_path)).first()) == ("graphclust", "a", 3)
    (tmp_path / "m.csv").write_text("marker_name,marker_id\ndapi,4\n")
    m = slides.read_markers(spark, f"file://{tmp_path}/m.csv")
    got = slides.resolve_markers(spark.createDataFrame([("Dapi",), ("zz",)], "channel string"), m)
    assert {(r["channel"], r["marker_id"], r["in_vocabulary"]) for r in got.collect()} == {("Dapi", 4, True), ("zz", 505, False)}


def test_embeddings(spark, tmp_path):
    np.savez(tmp_path / "e.npz", embeddings=np.arange(6, dtype=np.float32).reshape(2, 3), cell_ids=np.array(["a", "b"]))
    assert {r["cell_id"]: r["embedding"] for r in slides.read_embeddings(spark, f"{tmp_path}/e.npz").collect()} == {"a": [0, 1, 2], "b": [3, 4, 5]}
    spark.createDataFrame([("a", 1.0, 2)], "barcode string, u double, v int").write.parquet(f"file://{tmp_path}/e.parquet")
    assert slides.read_embeddings(spark, f"file://{tmp_path}/e.parquet").first()["embedding"] == [1, 2]
    n = slides.number_cells(spark.createDataFrame([("b",), ("a",), ("c",)], "cell_id string"), "cell_id")
    assert sorted(r["cell_ix"] for r in n.collect()) == [0, 1, 2]


def test_embeddings_sink_is_tagged(spark, tmp_path):
    data, other = catalog.dataset(str(tmp_path), "one"), catalog.dataset(str(tmp_path), "two")
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "cell_id string, embedding array<double>")
    path = catalog.write_embeddings(vectors, data, "v1", model="m")
    assert data.embeddings_file("v1") == path and spark.read.parquet(path).first()["embedding"] == [1, 2]
    catalog.check_tag(data, "v1")
    catalog.write_embeddings(vectors, other, "v1")
    with pytest.raises(ValueError):
        data.embeddings_file(f"{other.folder}/embeddings/v1.parquet")
    with pytest.raises(ValueError):
        catalog.write_embeddings(vectors, data, "../v1")
    known = spark.createDataFrame([("DAPI", "7", 0.1, 0.2)], "marker_name string, marker_id string, marker_mean double, marker_std double")
    got = {r["marker_name"]: (r["marker_id"], r["marker_mean"]) for r in catalog.register_markers(known, ["dapi", "NEW", "NEW"]).collect()}
    assert got == {"DAPI": (7, 0.1), "NEW": (8, catalog.NOVEL_MEAN)}


def test_polygons_follow_the_cells(spark):
    bundle = {"cells": spark.createDataFrame([("b",), ("a",), ("c",)], "cell_id string"), "polygons": spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "cell string, wkb binary")}
    assert {r["cell_id"]: r["wkb"] and bytes(r["wkb"]) for r in catalog.polygons_of(bundle).collect()} == {"a": b"1", "b": b"2", "c": None}


def test_stages_skip():
    ran = []
    assert Run().stage("bundle", lambda: False, lambda: ran.append(1)) and not Run().stage("bundle", lambda: True, lambda: ran.append(2))
    assert Run(start="bundle").stage("embed", lambda: True, lambda: ran.append(3)) and not Run(only="figures").stage("embed", lambda: False, lambda: ran.append(4))
    assert ran == [1, 3]
    with pytest.raises(SystemExit):
        Run(only="nothing")


def test_stream_runs_once(spark, tmp_path):
    spark.range(10).withColumn("t", F.timestamp_seconds("id")).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        s = ingest.first_deliveries(ingest.stream_table(spark, f"file://{tmp_path}/in").withColumn("k", F.col("id") % 3), ["k"], "t", "1 hour")
        ingest.sink_batches(s, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3
