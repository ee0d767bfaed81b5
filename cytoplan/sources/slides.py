"""Raw slide inputs as DataFrames: locating exports, outlines, cells, labels, clusterings, markers."""

from __future__ import annotations

import fnmatch
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

#: The members of an export that are read, and the outlines file that marks one.
MEMBERS = ("cell_boundaries.parquet", "nucleus_boundaries.parquet", "cells.parquet", "cell_feature_matrix.h5", "experiment.xenium", "analysis.tar.gz", "morphology.ome.tif")
OUTLINES = "cell_boundaries.parquet"
#: Fixed value: a ring takes at least so many vertex rows.
LEAST_VERTICES = 4


def locate_export(path: str, cache: str | None = None) -> Path:
    """The folder with the outlines: path itself, else its first child that has them, else its first *_outs.zip (or path, if a zip), extracted."""
    p = Path(path)
    if p.suffix == ".zip":
        return extract_export(p, Path(cache or p.parent) / p.stem)
    if (p / OUTLINES).exists():
        return p
    for child in sorted(x for x in p.glob("*/") if (x / OUTLINES).exists()):
        return child
    for archive in sorted(p.glob("*_outs.zip")):
        return extract_export(archive, Path(cache or p) / archive.stem)
    raise FileNotFoundError(f"no slide export under {path}")


def extract_export(archive: Path, to: Path, force: bool = False) -> Path:
    """Extracts the members that are read; nothing to do if the outlines are there already. Paths inside the archive are not followed."""
    if (to / OUTLINES).exists() and not force:
        return to
    to.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if (leaf := Path(name).name) in MEMBERS:
                (to / leaf).write_bytes(z.read(name))
    return to


def read_experiment(folder: str) -> dict:
    """The export's description; missing: an error."""
    return json.loads((Path(folder) / "experiment.xenium").read_text())


def read_outlines(spark: SparkSession, path: str, pixel_size: float) -> DataFrame:
    """cell_id, xs, ys (pixels) of cells with at least LEAST_VERTICES vertex rows, in file order.

    Only three columns are read. Order comes from a column vertex_ix where the file has one, else from the row's place in the file.
    """
    raw = spark.read.parquet(path)
    order = F.col("vertex_ix") if "vertex_ix" in raw.columns else F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    v = raw.select(F.col("cell_id").cast("string").alias("cell_id"), (F.col("vertex_x") / pixel_size).alias("x"), (F.col("vertex_y") / pixel_size).alias("y"), order.alias("o"))
    rings = v.filter("cell_id is not null").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("o", "x", "y"))).alias("v")).filter(F.size("v") >= LEAST_VERTICES)
    return rings.select("cell_id", F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def read_labelled_csv(spark: SparkSession, folder: str, pattern: str, required: list[str]) -> DataFrame | None:
    """The first file of the pattern in name order, as strings, with row_ix, its rows' order; None without one, an error without the required columns."""
    files = fnmatch.filter(storage.children(folder), pattern)
    if not files:
        return None
    df = spark.read.csv(storage.join(folder, files[0]), header=True)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{files[0]} lacks {', '.join(missing)}")
    return df.withColumn("row_ix", F.monotonically_increasing_id())


def read_cell_groups(spark: SparkSession, folder: str) -> DataFrame | None:
    return read_labelled_csv(spark, folder, "*cell_groups.csv", ["cell_id", "group"])


def read_gene_groups(spark: SparkSession, folder: str) -> DataFrame | None:
    return read_labelled_csv(spark, folder, "*gene_groups.csv", ["gene", "group"])


def gene_group_map(groups: DataFrame, gene: str = "gene", group: str = "group") -> DataFrame:
    """group, genes: the sorted distinct genes of each group."""
    return groups.groupBy(group).agg(F.sort_array(F.collect_set(gene)).alias("genes"))


def first_gene_group(groups: DataFrame, gene: str, group: str, order: str | None = None) -> DataFrame:
    """gene, gene_group: one group per gene: that of its first row by order (row_ix of a file), without an order the least by name."""
    return groups.groupBy(gene).agg((F.min_by(group, order) if order else F.min(group)).alias("gene_group"))


def read_clusters(spark: SparkSession, folder: str) -> DataFrame | None:
    """clustering, barcode, cluster_no of every clusters.csv of the export, in long form; an archive is read as it is, by a task, without unpacking it."""
    packed, home = storage.join(folder, "analysis.tar.gz"), storage.join(folder, "analysis/clustering")
    if storage.exists(packed):
        rows = spark.read.format("binaryFile").load(packed).select("content").mapInPandas(_packed_clusters, "clustering string, barcode string, cluster_no int")
    elif storage.children(home):
        df = spark.read.csv(storage.join(home, "*/clusters.csv"), header=True).withColumn("p", F.input_file_name())
        rows = df.select(F.regexp_extract("p", r"([^/]+)/clusters\.csv$", 1).alias("clustering"), F.col("Barcode").alias("barcode"), F.col("Cluster").cast("int").alias("cluster_no"))
    else:
        return None
    return rows.withColumn("clustering", F.regexp_replace("clustering", "^gene_expression_", ""))


def _packed_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for m in t:
                    if m.isfile() and m.name.endswith("clusters.csv"):
                        got = pd.read_csv(t.extractfile(m), dtype={"Barcode": str})
                        yield pd.DataFrame({"clustering": Path(m.name).parent.name, "barcode": got["Barcode"], "cluster_no": got["Cluster"].astype("int32")})


def read_markers(spark: SparkSession, path: str | None) -> DataFrame | None:
    """marker_name (upper case), marker_id and statistics; None for no path, an error without the required columns."""
    if path is None:
        return None
    df = spark.read.csv(path, header=True)
    if missing := [c for c in ("marker_name", "marker_id") if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.withColumn("marker_name", F.upper("marker_name")).withColumn("marker_id", F.col("marker_id").cast("int"))


#: Fixed value: id of a marker outside the vocabulary.
OUT_OF_VOCABULARY = 505


def resolve_markers(channels: DataFrame, markers: DataFrame) -> DataFrame:
    """channel, marker_id, in_vocabulary: by upper-case name; an unknown name gets the id outside the vocabulary. markers: one row per name (keep the least id)."""
    one = markers.groupBy(F.upper("marker_name").alias("__m")).agg(F.min("marker_id").alias("marker_id"))
    out = channels.withColumn("__m", F.upper("channel")).join(one, "__m", "left").drop("__m")
    return out.withColumn("in_vocabulary", F.col("marker_id").isNotNull()).withColumn("marker_id", F.coalesce("marker_id", F.lit(OUT_OF_VOCABULARY)))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """cell_ix, gene_ix, n: sparse counts in long form, zeros and nulls left out, repeated entries added."""
    return spark.read.parquet(path).select("cell_ix", "gene_ix", "n").filter("n > 0").groupBy("cell_ix", "gene_ix").agg(F.sum("n").alias("n"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, embedding: from parquet with an id column (cell, cell_id or barcode) and a list column embedding or numeric columns, or from .npz files (embeddings, cell_ids)."""
    if path.endswith(".npz"):
        return _read_npz(spark, path)
    df = spark.read.parquet(path)
    ident = next((c for c in ("cell", "cell_id", "barcode") if c in df.columns), None)
    if ident is None:
        raise ValueError("no id column: cell, cell_id or barcode")
    if "embedding" in df.columns:
        vec = F.transform("embedding", lambda e: e.cast("float"))
    else:
        numeric = [c for c, t in df.dtypes if c != ident and t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
        vec = F.array(*(F.col(c).cast("float") for c in numeric))
    return df.select(F.col(ident).cast("string").alias("cell_id"), vec.alias("embedding"))


def _read_npz(spark: SparkSession, path: str) -> DataFrame:
    import io

    import numpy as np
    import pandas as pd

    def load(batches):
        for pdf in batches:
            for content in pdf["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(z["cell_ids"]), 10_000):
                    part = slice(at, at + 10_000)
                    yield pd.DataFrame({"cell_id": z["cell_ids"][part].astype(str), "embedding": list(z["embeddings"][part].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "cell_id string, embedding array<float>")


def number_cells(cells: DataFrame, ident: str) -> DataFrame:
    """cells with cell_ix, dense from 0: ids fall into 256 pieces by hash, which are counted and then ranked by id, so no task sorts all of them."""
    ends = cells.select(ident).distinct()
    part = F.conv(F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 2), 16, 10).cast("int")
    counts = ends.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    ranked = ends.withColumn("__p", part).withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(ident)))
    ix = ranked.join(F.broadcast(before), "__p").select(ident, (F.col("__b") + F.col("__r") - 1).alias("cell_ix"))  # 256 rows
    return cells.join(ix, ident)
