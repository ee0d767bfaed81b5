"""The latent-variable model: attention over cell graphs, tile forward pass, loss terms and simulation, in numpy per tile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.equations import EPS
from .graph import directed, segment_softmax

#: Sizes of the model's parts, and weights of the loss.
SIZES = {"z": 20, "w": 6, "hidden": 256, "type": 16, "gat": 32, "heads": 4}
OMEGA, ALPHA_Z, ALPHA_W, ALPHA_A = 1.0, 1.0, 1.0, 0.0


def mlp(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Linear layers with ReLU between them."""
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        x = np.maximum(x, 0) if k + 1 < len(layers) else x
    return x


def gat(h_src: np.ndarray, h_dst: np.ndarray, src: np.ndarray, dst: np.ndarray, ws: np.ndarray, wd: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention of destinations over their in-edges (second form: the score is a' leaky(ws h_s + wd h_d)); heads averaged, empty destinations zero. ws, wd: (in, heads, out); a: (heads, out). Returns (values, alpha by edge and head)."""
    s, d = np.einsum("ni,iho->nho", h_src, ws), np.einsum("ni,iho->nho", h_dst, wd)
    u = s[src] + d[dst]
    score = (np.where(u > 0, u, 0.2 * u) * a).sum(-1)
    top = np.full((len(h_dst), a.shape[0]), -np.inf)
    np.maximum.at(top, dst, score)
    e = np.exp(score - top[dst])
    total = np.zeros_like(top)
    np.add.at(total, dst, e)
    alpha = e / np.maximum(total[dst], 1e-300)
    out = np.zeros((len(h_dst), *s.shape[1:]))
    np.add.at(out, dst, alpha[..., None] * s[src])
    return out.mean(axis=1), alpha


def attention(edges: DataFrame, scores: str, values: list[str]) -> DataFrame:
    """dst and the attention-weighted sums of values over in-edges: rows dst, scores, values."""
    rows = edges.withColumn("alpha", segment_softmax(["dst"], scores))
    return rows.groupBy("dst").agg(*(F.sum(F.col("alpha") * F.col(v)).alias(v) for v in values))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


@dataclass(frozen=True)
class Weights:
    """Parameters of the model by name; every MLP is a list of (matrix, offset)."""

    type_embedding: np.ndarray
    enc_z: list
    enc_w: list
    prior_w: list
    dec_a: list
    niche: np.ndarray
    ws: np.ndarray
    wd: np.ndarray
    a: np.ndarray


def random_weights(genes: int, types: int, image: int = 0, seed: int = 0, sizes: dict[str, int] = SIZES) -> Weights:
    """Small random parameters for tests and as a start; image: width of the image features."""
    rng = np.random.default_rng(seed)
    z, w, h, t, g, k = (sizes[n] for n in ("z", "w", "hidden", "type", "gat", "heads"))
    context = g + image + 1

    def layers(*widths: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(rng.normal(0, 1 / np.sqrt(i), (i, o)), np.zeros(o)) for i, o in zip(widths, widths[1:])]

    return Weights(
        type_embedding=rng.normal(size=(types, t)),
        enc_z=layers(genes + t, h, h, 2 * z),
        enc_w=layers(context + t + z + genes, h, 2 * w),
        prior_w=layers(context + t, max(1, h // 4), w),
        dec_a=layers(z, h, genes),
        niche=rng.normal(0, 0.1, (w, genes)),
        ws=rng.normal(0, 0.3, (types + z, k, g)),
        wd=rng.normal(0, 0.3, (t, k, g)),
        a=rng.normal(0, 0.3, (k, g)),
    )


def mixed_log_profile(own: np.ndarray, influx: np.ndarray, kappa: float) -> np.ndarray:
    """Logarithm of (1 - kappa) own + kappa influx by row, which sums to one again, floored at EPS."""
    both = (1 - kappa) * own + kappa * influx
    return np.log(np.maximum(both / np.maximum(both.sum(axis=1, keepdims=True), EPS), EPS))


def tile_forward(
    p: Weights, x: np.ndarray, kind: np.ndarray, image: np.ndarray, isolated: np.ndarray, seeds: int, ring1: int,
    gat_edges: tuple[np.ndarray, np.ndarray], leak: tuple[np.ndarray, np.ndarray, np.ndarray], kappa: float, rng: np.random.Generator,
) -> dict[str, np.ndarray]:
    """Forward pass of one tile, nodes in the order seeds, ring 1, ring 2.

    x: counts, kind: type numbers, image: image features (any width, also none), isolated: whether a cell has no edge; gat_edges: (src, dst) into seeds and ring 1; leak:
    (src, dst, beta) into seeds. z is found for every node, context, w and rho for seeds and ring 1, mixtures for seeds. Counts enter by log1p; attention asks by type, never by z; the
    decoder never sees the type. The prior of w has variance one. The influx is that of the posterior draw in both mixtures: log_p with it, log_p_prior with w from the prior.
    """
    context_size = seeds + ring1
    counts, emb = np.log1p(x), p.type_embedding[kind]
    mu_z, logvar_z = np.split(mlp(p.enc_z, np.concatenate([counts, emb], 1)), 2, axis=1)
    z = mu_z + np.exp(logvar_z / 2) * rng.standard_normal(mu_z.shape)
    inner = slice(0, context_size)
    seen, alpha = gat(np.concatenate([np.eye(len(p.type_embedding))[kind], mu_z], 1), emb[inner], *gat_edges, p.ws, p.wd, p.a)
    context = np.concatenate([seen, image[inner], isolated[inner, None].astype(float)], 1)
    known = np.concatenate([context, emb[inner]], 1)
    prior_w = mlp(p.prior_w, known)
    mu_w, logvar_w = np.split(mlp(p.enc_w, np.concatenate([known, z[inner], counts[inner]], 1)), 2, axis=1)
    w = mu_w + np.exp(logvar_w / 2) * rng.standard_normal(mu_w.shape)
    profile = lambda zs, ws: log_softmax(mlp(p.dec_a, zs) + ws @ p.niche)
    log_rho = profile(z[inner], w)
    influx = np.zeros((seeds, x.shape[1]))
    np.add.at(influx, leak[1], leak[2][:, None] * np.exp(log_rho)[leak[0]])
    other_w = prior_w[:seeds] + rng.standard_normal(mu_w[:seeds].shape)
    return {
        "mu_z": mu_z, "logvar_z": logvar_z, "z": z, "context": context, "alpha": alpha, "prior_w": prior_w, "mu_w": mu_w, "logvar_w": logvar_w, "w": w,
        "log_rho": log_rho, "influx": influx, "log_p": mixed_log_profile(np.exp(log_rho[:seeds]), influx, kappa),
        "log_p_prior": mixed_log_profile(np.exp(profile(z[:seeds], other_w)), influx, kappa),
    }


def loss_terms(f: dict[str, np.ndarray], x: np.ndarray, penalty: float = 0.0, omega: float = OMEGA, a_z: float = ALPHA_Z, a_w: float = ALPHA_W, a_a: float = ALPHA_A) -> dict[str, float]:
    """Means over the seeds (x: their counts) of both reconstructions, in which a cell's log likelihood is divided by its total, and of the divergences, and the loss.

    z has a standard normal prior, which both bounds carry, so kl_z counts 1 + omega times; w has the context's mean and variance one.
    """
    n = len(x)
    per_count = lambda log_p: float(((x * log_p).sum(axis=1) / np.maximum(x.sum(axis=1), 1)).mean())
    kl = lambda mean, logvar, prior: float(0.5 * (np.exp(logvar) + (mean - prior) ** 2 - 1 - logvar).sum(axis=1).mean())
    terms = {
        "recon_a": per_count(f["log_p"]),
        "recon_b": per_count(f["log_p_prior"]),
        "kl_z": kl(f["mu_z"][:n], f["logvar_z"][:n], 0.0),
        "kl_w": kl(f["mu_w"][:n], f["logvar_w"][:n], f["prior_w"][:n]),
    }
    return terms | {"loss": loss(terms, penalty, omega, a_z, a_w, a_a)}


def loss(terms: dict[str, float], penalty: float = 0.0, omega: float = OMEGA, a_z: float = ALPHA_Z, a_w: float = ALPHA_W, a_a: float = ALPHA_A) -> float:
    """Minus the bound: recon_a + omega recon_b - (1 + omega) a_z kl_z - a_w kl_w - a_a penalty."""
    return -(terms["recon_a"] + omega * terms["recon_b"] - (1 + omega) * a_z * terms["kl_z"] - a_w * terms["kl_w"] - a_a * penalty)


def tile_losses(nodes: DataFrame, edges: DataFrame, p: Weights, kappa: float, seed: int = 0) -> DataFrame:
    """tile, n_seeds, recon_a, recon_b, kl_z, kl_w, loss: the forward pass and loss of every tile in a task of its own.

    nodes: tile, local_ix, ring, counts (array), type (number), image (array), isolated, as gathered for tile_batch's nodes; edges: tile, src_ix, dst_ix, leak and beta. A tile is as large
    as spatial_tiles allows, plus its rings. Draws depend on the tile and seed only. A tile without seeds has no row.
    """
    kind = dict(nodes.dtypes)["tile"]

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("local_ix")
        seeds, ring1 = int((n["ring"] == 0).sum()), int((n["ring"] == 1).sum())
        columns = ["tile", "n_seeds", "recon_a", "recon_b", "kl_z", "kl_w", "loss"]
        if not seeds:
            return pd.DataFrame(columns=columns)
        x = np.stack(n["counts"].to_numpy()).astype(float)
        image = np.stack(n["image"].to_numpy()).astype(float).reshape(len(n), -1)
        tile = n["tile"].iloc[0]
        rng = np.random.default_rng([seed, *str(tile).encode()])
        own = e[e["leak"]]
        pairs = lambda d: (d["src_ix"].to_numpy(int), d["dst_ix"].to_numpy(int))
        f = tile_forward(p, x, n["type"].to_numpy(int), image, n["isolated"].to_numpy(bool), seeds, ring1, pairs(e), (*pairs(own), own["beta"].to_numpy(float)), kappa, rng)
        t = loss_terms(f, x[:seeds])
        return pd.DataFrame([[tile, seeds, *(t[c] for c in columns[2:])]], columns=columns)

    return nodes.groupBy("tile").cogroup(edges.groupBy("tile")).applyInPandas(run, f"tile {kind}, n_seeds bigint, recon_a double, recon_b double, kl_z double, kl_w double, loss double")


def edge_gated_layer(h: np.ndarray, src: np.ndarray, dst: np.ndarray, edge_values: np.ndarray, message: tuple, gate: list, update: tuple) -> np.ndarray:
    """One message step: neighbours' messages times a sigmoid of the edge's values, averaged over in-edges, joined to the node's own state; a node without edges gets zeros."""
    weight = 1 / (1 + np.exp(-mlp(gate, edge_values)))
    sent = (h @ message[0] + message[1])[src] * weight
    pooled, n = np.zeros_like(h), np.zeros((len(h), 1))
    np.add.at(pooled, dst, sent)
    np.add.at(n, dst, 1.0)
    return np.maximum(np.concatenate([h, pooled / np.maximum(n, 1)], axis=1) @ update[0] + update[1], 0)


def type_logits(parts: dict, x: np.ndarray, seeds: np.ndarray, src: np.ndarray, dst: np.ndarray, edge_values: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Scores of each type for a batch's seeds: counts through an encoder and edge-gated layers, image features through their own, joined at the end. parts: encode, layers, image, head."""
    h = np.maximum(mlp([parts["encode"]], np.log1p(x)), 0)
    for layer in parts["layers"]:
        h = edge_gated_layer(h, src, dst, edge_values, *layer)
    seen = np.maximum(mlp([parts["image"]], image), 0)
    return mlp([parts["head"]], np.concatenate([h[seeds], seen], axis=1))


def tile_batch(edges: DataFrame, seeds: DataFrame, tile: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: tile, id, ring, local_ix; edges: tile, src_ix, dst_ix, leak) of each tile: nodes in the order seeds, ring 1, ring 2, by id within; edges into seeds and ring 1, leak where into seeds."""
    from pyspark.sql import Window

    from .graph import rings

    nodes = rings(edges, seeds, tile, ident)
    nodes = nodes.withColumn("local_ix", (F.row_number().over(Window.partitionBy(tile).orderBy("ring", "id")) - 1).cast("bigint"))
    into = nodes.filter("ring < 2").select(F.col(tile).alias("t"), F.col("id").alias("dst"), F.col("local_ix").alias("dst_ix"), (F.col("ring") == 0).alias("leak"))
    two = directed(edges, []).select("dst", "src")
    at = nodes.select(F.col(tile).alias("t"), F.col("id").alias("src"), F.col("local_ix").alias("src_ix"))
    return nodes, into.join(two, "dst").join(at, ["t", "src"]).select(F.col("t").alias(tile), "src_ix", "dst_ix", "leak")


#: Fixed values of the simulation: spread of the types' anchors (share of the side), of z, of w and of the image features about their means.
ANCHOR_SPREAD, Z_SPREAD, W_SPREAD, IMAGE_SPREAD = 0.05, 0.5, 0.3, 0.4


def simulate(spark, n: int, types: int = 4, genes: int = 60, z: int = 4, w: int = 2, image: int = 8, kappa: float = 0.2, mean_counts: float = 150.0, side: float = 1000.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A simulated tissue: (cells, edges), the same for any partitioning.

    cells: cell_ix, x, y, type, y_niche (shares of the neighbours' types; empty if alone), z, w, rho, p, total, counts, image. Places are uniform, types follow the nearest of seeded anchors with
    Gumbel noise; edges (i, j, distance) are neighbours in the Voronoi diagram within MODEL_EDGE_UM and carry equal walls; z scatters about its type's mean, w about a linear
    reading of the niche; rho = softmax(z A + w B); p mixes rho with the neighbours' by kappa and their smoothing weights (alone: rho itself); counts are multinomial of a Poisson total of 20 at least;
    image features read the niche as well.
    """
    from .graph import MODEL_EDGE_UM, prune, smoothing_weights, voronoi_edges

    rng = np.random.default_rng(seed)
    anchors, kinds = rng.uniform(0, side, (3 * types, 2)), np.arange(3 * types) % types
    means, read, load_z, load_w, look = rng.normal(0, 1.5, (types, z)), rng.normal(size=(types, w)), rng.normal(size=(z, genes)), rng.normal(size=(w, genes)), rng.normal(size=(types, image))

    def place(batches):
        for pdf in batches:
            rows = []
            for ix in pdf["id"]:
                r = np.random.default_rng([seed, 1, int(ix)])
                at = r.uniform(0, side, 2)
                gap = np.hypot(*(anchors - at).T)
                rows.append((int(ix), *at.tolist(), int(kinds[np.argmax(r.gumbel(size=len(anchors)) - gap / (ANCHOR_SPREAD * side))])))
            yield pd.DataFrame(rows, columns=["cell_ix", "x", "y", "type"])

    cells = spark.range(n).mapInPandas(place, "cell_ix bigint, x double, y double, type int")
    near = voronoi_edges(cells.withColumn("space", F.lit(0)), "space", "cell_ix", "x", "y", clip=MODEL_EDGE_UM)
    edges, _ = prune(near.select("i", "j", "distance"), "distance")
    beside = directed(edges, []).join(cells.select(F.col("cell_ix").alias("src"), "type"), "src")
    counts = beside.groupBy("dst").agg(*(F.sum((F.col("type") == t).cast("int")).alias(f"t{t}") for t in range(types)), F.count(F.lit(1)).alias("d"))
    shares = counts.select(F.col("dst").alias("cell_ix"), F.array(*(F.col(f"t{t}") / F.col("d") for t in range(types))).alias("y_niche"))
    known = cells.join(shares, "cell_ix", "left").withColumn("y_niche", F.coalesce("y_niche", F.array().cast("array<double>")))

    def express(batches):
        for pdf in batches:
            out = []
            for ix, t, y in zip(pdf["cell_ix"], pdf["type"], pdf["y_niche"]):
                r, niche = np.random.default_rng([seed, 2, int(ix)]), np.asarray(y, float) if len(y) else np.zeros(types)
                own_z = means[t] + Z_SPREAD * r.standard_normal(z)
                own_w = niche @ read + W_SPREAD * r.standard_normal(w)
                out.append((own_z.tolist(), own_w.tolist(), np.exp(log_softmax(own_z @ load_z + own_w @ load_w)).tolist(), (niche @ look + IMAGE_SPREAD * r.standard_normal(image)).tolist()))
            yield pdf.assign(**dict(zip(("z", "w", "rho", "image"), map(list, zip(*out))))) if out else pdf.assign(z=[], w=[], rho=[], image=[])

    many = "array<double>"
    expressed = known.mapInPandas(express, f"cell_ix bigint, x double, y double, type int, y_niche {many}, z {many}, w {many}, rho {many}, image {many}")
    beta = smoothing_weights(edges.withColumn("face", F.lit(1.0)), "face", "distance").select("dst", "src", "beta")
    flow = beta.join(expressed.select(F.col("cell_ix").alias("src"), "rho"), "src").groupBy("dst").agg(F.array(*(F.sum(F.col("beta") * F.get("rho", F.lit(g))) for g in range(genes))).alias("flow"))
    both = expressed.join(flow.withColumnRenamed("dst", "cell_ix"), "cell_ix", "left")
    mixed = both.withColumn("p", F.when(F.col("flow").isNull(), F.col("rho")).otherwise(F.zip_with("rho", "flow", lambda a, b: (1 - kappa) * a + kappa * b))).drop("flow")

    def count(batches):
        for pdf in batches:
            totals, drawn = [], []
            for ix, p in zip(pdf["cell_ix"], pdf["p"]):
                r = np.random.default_rng([seed, 3, int(ix)])
                totals.append(max(20, int(r.poisson(mean_counts))))
                share = np.asarray(p, float)
                drawn.append(r.multinomial(totals[-1], share / share.sum()).tolist())
            yield pdf.assign(total=totals, counts=drawn)

    names = ["cell_ix", "x", "y", "type", "y_niche", "z", "w", "rho", "image", "p"]
    fields = ", ".join(f"{c} {t}" for c, t in mixed.select(*names).dtypes)
    return mixed.select(*names).mapInPandas(count, f"{fields}, total bigint, counts array<bigint>"), edges
