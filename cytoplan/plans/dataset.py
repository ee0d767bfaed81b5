"""A cell graph opened for serving: cells, edges with ids and weights, labels, vectors, and batches gathered from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignment import centre_and_mask, dense_codes, folded_label
from ..operators.batching import batch_edges, batch_nodes, epoch_batches, global_rank
from ..operators.graph import DECAY_UM, composition, directed, niche, prune, smoothing_weights
from ..operators.model import tile_batch
from ..sources.catalog import load_bundle, resolve_bundle

#: Metrics an edge of a batch carries.
EDGE_METRICS = ("centroid_dist_um", "shared_wall_um")


@dataclass(frozen=True)
class Batch:
    """All batches at once, told apart by batch_id: nodes, directed edges into the seeds, and the seeds in their order."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame


@dataclass(frozen=True)
class CellGraph:
    """cells: cell_ix, x_um, y_um, type, and any more columns (counts, labels); links: i < j and metrics of one graph; vectors: cell_ix, image_embedding, or None.

    images: which nodes of a batch carry a vector: seeds or nodes. Cells without a vector have zeros and found = false.
    """

    cells: DataFrame
    links: DataFrame
    vectors: DataFrame | None = None
    width: int = 64
    images: str = "seeds"

    def __post_init__(self) -> None:
        if self.images not in ("seeds", "nodes"):
            raise ValueError(f"images must be seeds or nodes, not {self.images!r}")

    @cached_property
    def edges(self) -> DataFrame:
        """links with edge_id: their place from 0 in the order of i and j."""
        return numbered_edges(self.links)

    @cached_property
    def weights(self) -> DataFrame:
        """dst, src, into_j, beta of every directed edge."""
        return smoothing_weights(self.links, "shared_wall_um", "centroid_dist_um", DECAY_UM)

    @cached_property
    def types(self) -> DataFrame:
        """type and its code."""
        return dense_codes(self.cells, "type")

    @cached_property
    def composition(self) -> DataFrame:
        """type, neighbour_type, share, support."""
        return composition(niche(self.links, self.cells, "cell_ix", "type"), self.cells, "cell_ix", "type")

    @cached_property
    def imaged(self) -> DataFrame:
        """cell_ix, image_embedding, found of every cell."""
        ids = self.cells.select("cell_ix")
        if self.vectors is None:
            return ids.select("cell_ix", F.array_repeat(F.lit(0.0).cast("float"), self.width).alias("image_embedding"), F.lit(False).alias("found"))
        return centre_and_mask(ids, self.vectors, "cell_ix", "image_embedding", self.width)

    def length(self, size: int) -> int:
        """Batches of an epoch, a short last one included."""
        return ceil(self.cells.count() / size)

    def batches(self, size: int = 64, seed: int = 0, drop_last: bool = False) -> Batch:
        """Every cell seeds one batch, in a shuffled order."""
        return self.batch_from_seeds(epoch_batches(self.cells, "cell_ix", size, seed, drop_last))

    def batch_from_seeds(self, seeds: DataFrame) -> Batch:
        """Batches about given seeds (batch_id, cell_ix, and seed_index if they have an order): seeds, their neighbours, and the edges from those into the seeds.

        nodes: batch_id, local_ix, is_seed and the cell's columns, image_embedding and found where images has them (else null); edges: batch_id, src_ix, dst_ix, edge_id, metrics, beta;
        seeds: batch_id, seed_index, local_ix, cell_ix, type, image_embedding, found. A seed that is no cell is left out, one given twice in a batch counts once.
        """
        order = "seed_index" if "seed_index" in seeds.columns else "cell_ix"
        one = seeds.dropna(subset=["batch_id", "cell_ix"]).groupBy("batch_id", "cell_ix").agg(F.min(order).alias("seed_index")).join(self.cells.select("cell_ix"), "cell_ix", "left_semi")
        nodes = batch_nodes(one, "batch_id", "cell_ix", self.links).withColumnRenamed("id", "cell_ix")
        placed = nodes.select("batch_id", "cell_ix", "local_ix")
        shown = nodes.join(self.cells, "cell_ix").join(self.imaged, "cell_ix")
        if self.images == "seeds":
            shown = shown.withColumns({c: F.when(F.col("is_seed"), F.col(c)) for c in ("image_embedding", "found")})
        lookup = directed(self.edges, ["edge_id", *EDGE_METRICS]).drop("into_j").join(self.weights.select("dst", "src", "beta"), ["dst", "src"])
        into = batch_edges(one, "batch_id", "cell_ix", self.links).join(lookup, ["dst", "src"])
        end = lambda c: placed.select("batch_id", F.col("cell_ix").alias(c), F.col("local_ix").alias(f"{c}_ix"))
        edges = into.join(end("src"), ["batch_id", "src"]).join(end("dst"), ["batch_id", "dst"]).select("batch_id", "src_ix", "dst_ix", "edge_id", *EDGE_METRICS, "beta")
        lead = one.join(placed, ["batch_id", "cell_ix"]).join(self.cells.select("cell_ix", "type"), "cell_ix").join(self.imaged, "cell_ix")
        return Batch(shown, edges, lead.select("batch_id", "seed_index", "local_ix", "cell_ix", "type", "image_embedding", "found"))

    def tiles(self, seeds: DataFrame, tile: str, longest: float = 40.0) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of tiles with both rings, over edges up to longest: nodes: tile, cell_ix, ring, local_ix, isolated; edges: tile, src_ix, dst_ix, leak, beta.

        beta is that of the pruned graph. An edge whose source is not in the tile's halo would be an error of the rings; there can be none, and check_halo counts them.
        """
        kept, _ = prune(self.links, "centroid_dist_um", longest)
        nodes, edges = tile_batch(kept, seeds.select(F.col(tile).alias("tile"), "cell_ix"), "tile", "cell_ix")
        nodes = nodes.withColumnRenamed("id", "cell_ix")
        beta = smoothing_weights(kept, "shared_wall_um", "centroid_dist_um", DECAY_UM).select("dst", "src", "beta")
        end = lambda c: nodes.select("tile", F.col("local_ix").alias(f"{c}_ix"), F.col("cell_ix").alias(c))
        edges = edges.join(end("src"), ["tile", "src_ix"]).join(end("dst"), ["tile", "dst_ix"]).join(beta, ["dst", "src"], "left").select("tile", "src_ix", "dst_ix", "leak", F.coalesce("beta", F.lit(0.0)).alias("beta"))
        connected = directed(kept, []).select(F.col("dst").alias("cell_ix")).distinct().withColumn("__c", F.lit(True))
        return nodes.join(connected, "cell_ix", "left").withColumn("isolated", F.col("__c").isNull()).drop("__c"), edges


def numbered_edges(links: DataFrame) -> DataFrame:
    """links with edge_id, their place from 0 in the order of i and j, found by counts of ranges of i."""
    most = links.agg(F.coalesce(F.max("i"), F.lit(0)).alias("m")).collect()[0]["m"]
    return global_rank(links, ["i", "j"], span=int(most) + 1).withColumnRenamed("__rank", "edge_id")


def check_halo(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """tile, n: edges whose source is no node of their tile; empty if the rings are whole."""
    have = nodes.select("tile", F.col("local_ix").alias("src_ix"))
    return edges.join(have, ["tile", "src_ix"], "left_anti").groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


def open_dataset(spark: SparkSession, root: str, name: str | None = None, variant: str = "default", graph: str = "voronoi", label: str = "cell_group", vectors: DataFrame | None = None, images: str = "seeds") -> CellGraph:
    """A bundle of the warehouse as a cell graph: cells numbered by id, one of its graphs, one label column folded to types."""
    tables = load_bundle(spark, *resolve_bundle(root, name, variant))
    if f"edges_{graph}" not in tables:
        raise ValueError(f"the bundle has no graph {graph}; it has {sorted(t[6:] for t in tables if t.startswith('edges_'))}")
    cells = tables["cells"]
    if label not in cells.columns:
        raise ValueError(f"the cells have no label {label}")
    number = global_rank(cells.select("cell_id", F.pmod(F.xxhash64("cell_id"), F.lit(1 << 32)).alias("__h")), ["__h", "cell_id"]).select("cell_id", F.col("__rank").alias("cell_ix"))
    named = cells.join(number, "cell_id").withColumn("type", folded_label(label))
    end = lambda c: number.select(F.col("cell_id").alias(c), F.col("cell_ix").alias(f"__{c}"))
    links = tables[f"edges_{graph}"].join(end("i"), "i").join(end("j"), "j")
    rest = [c for c in links.columns if c not in ("i", "j", "__i", "__j")]
    links = links.select(F.least("__i", "__j").alias("i"), F.greatest("__i", "__j").alias("j"), *rest)
    if vectors is not None:
        vectors = vectors.join(number, "cell_id").select("cell_ix", "image_embedding")
    return CellGraph(named, links, vectors, images=images)
