"""Equations of the latent-variable model as column expressions and small numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: floor of probabilities before a logarithm.
EPS = 1e-8


def multinomial_loglik(n: str | Column, p: str | Column, scaled: bool = False) -> Column:
    """Aggregate: sum of n ln p (p floored), over the larger of the total and 1 if scaled."""
    n, p = (F.col(c) if isinstance(c, str) else c for c in (n, p))
    total = F.sum(n * F.log(F.greatest(p, F.lit(EPS))))
    return total / F.greatest(F.sum(n), F.lit(1)) if scaled else total


def gaussian_kl(mq: Column, lq: Column, mp: Column, lp: Column) -> Column:
    """Divergence of diagonal Gaussians in one dimension, by means and log variances; sum it over the dimensions."""
    return (lp - lq + (F.exp(lq) + (mq - mp) * (mq - mp)) / F.exp(lp) - 1) / 2


def leakage_mix(own: Column, foreign: Column, kappa: float, cell: list[str]) -> Column:
    """ln of (1 - kappa) own + kappa foreign, renormalised within a cell (so isolated cells fall back to their own) and floored."""
    if not 0 <= kappa < 1:
        raise ValueError("kappa must lie in [0, 1)")
    mixed = own * (1 - kappa) + F.coalesce(foreign, F.lit(0.0)) * kappa
    return F.log(F.greatest(mixed / F.greatest(F.sum(mixed).over(Window.partitionBy(*cell)), F.lit(EPS)), F.lit(EPS)))


def foreign_influx(beta: DataFrame, profiles: DataFrame, ident: str, gene: str, value: str) -> DataFrame:
    """dst, gene, influx: beta-weighted sum of the neighbours' profiles; cells without neighbours have no row."""
    rows = beta.select("dst", "src", "beta").join(profiles.select(F.col(ident).alias("src"), F.col(gene).alias("gene"), F.col(value).alias("value")), "src")
    return rows.groupBy("dst", "gene").agg(F.sum(F.col("beta") * F.col("value")).alias("influx"))


def shrink_to_diagonal(matrix: np.ndarray, share: float) -> np.ndarray:
    """(1 - share) of the matrix plus share of its diagonal."""
    return (1 - share) * matrix + share * np.diag(np.diag(matrix))


def intensity_scale(dtype: str | Column) -> Column:
    """Greatest intensity by pixel type; types that have none are an error, a null stays null."""
    c = F.col(dtype) if isinstance(dtype, str) else dtype
    known = F.when(c == "uint8", 255.0).when(c.startswith("uint"), 65535.0).when(c.startswith("float"), 400.0)
    return known.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no greatest intensity for pixels of type "), c)).cast("double"))


class TypeCovariances:
    """Moving moments per type and the leakage penalty: half the log determinants of v and z less that of both, in correlation form, weighted by type share.

    A type's support is its moving number of rows in a batch over the rate; types below `least` (ten times the joint width unless given) are left out and reported.
    """

    def __init__(self, z_dim: int, v_dim: int, rate: float = 0.01, shrink: float = 0.05, least: float | None = None) -> None:
        self.z_dim, self.dim, self.rate, self.shrink = z_dim, z_dim + v_dim, rate, shrink
        self.least = 10.0 * self.dim if least is None else least
        self.mean: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}
        self.in_batch: dict[str, float] = {}
        self.last: dict[str, int] = {}

    def update(self, batch: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Moments of one batch by type: (rows, mean, second moments). A type's first ones are adopted outright, later ones at the rate; its number of rows always at the rate."""
        self.last = {k: n for k, (n, _, _) in batch.items() if n > 0}
        for kind, (n, mean, second) in batch.items():
            if n > 0:
                w = self.rate if kind in self.mean else 1.0
                self.mean[kind] = (1 - w) * self.mean.get(kind, 0) + w * mean
                self.second[kind] = (1 - w) * self.second.get(kind, 0) + w * second
                self.in_batch[kind] = (1 - self.rate) * self.in_batch.get(kind, 0.0) + self.rate * n

    def support(self, kind: str) -> float:
        return self.in_batch.get(kind, 0.0) / self.rate

    def penalty(self, shares: dict[str, float] | None = None) -> tuple[float, float]:
        """(penalty over the types of the last batch, share of its rows in types with too little support). shares: the types' weights; without, those of the last batch."""
        rows = sum(self.last.values())
        out, left = 0.0, 0
        for kind, n in self.last.items():
            if self.support(kind) < self.least:
                left += n
                continue
            cov = self.second[kind] - np.outer(self.mean[kind], self.mean[kind])
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            c = shrink_to_diagonal(cov / np.outer(sd, sd), self.shrink) + 1e-5 * np.eye(self.dim)
            det = lambda m: np.linalg.slogdet(m)[1]
            weight = shares.get(kind, 0.0) if shares is not None else n / rows
            out += weight * 0.5 * (det(c[: self.z_dim, : self.z_dim]) + det(c[self.z_dim :, self.z_dim :]) - det(c))
        return out, left / rows if rows else 0.0


def type_moments(rows: DataFrame, kind: str, values: list[str]) -> DataFrame:
    """kind, n, mean (array) and second (array, row by row): moments per type in one aggregation."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(v) for v in values)).alias("mean"), F.array(*(F.avg(F.col(a) * F.col(b)) for a in values for b in values)).alias("second"))
