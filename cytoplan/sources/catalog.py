"""Datasets in a warehouse folder: names, bundles, manifests and sinks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import slug_text
from . import storage


@dataclass(frozen=True)
class Dataset:
    """A dataset's folder under the warehouse, which may lie on any store the session reads; its id is the slug of its name."""

    root: str
    name: str

    @property
    def folder(self) -> str:
        return storage.join(self.root, self.name)

    def bundle(self, variant: str = "default") -> str:
        if "/" in variant or os.sep in variant or variant in ("", ".", ".."):
            raise ValueError(f"no name of a variant: {variant!r}")
        return storage.join(self.folder, "bundles", variant)

    def variants(self) -> list[str]:
        home = storage.join(self.folder, "bundles")
        return [v for v in storage.children(home) if storage.exists(storage.join(home, v, "params.json"))]

    def embeddings_file(self, name: str | None) -> str | None:
        """A file of the dataset by path or by bare name; one outside the folder is refused, an unresolved name is returned as given."""
        if name is None:
            return None
        for p in (name, *(storage.join(self.folder, "embeddings", f"{name}{s}") for s in ("", ".parquet", ".npz"))):
            if storage.exists(p):
                if not storage.qualified(p).startswith(storage.qualified(self.folder).rstrip("/") + "/"):
                    raise ValueError(f"{p} lies outside {self.folder}")
                return p
        return name

    def manifest(self) -> dict:
        """The stored facts; none if the file is missing or broken."""
        try:
            return json.loads(storage.read_text(storage.join(self.folder, "dataset.json")) or "{}")
        except ValueError:
            return {}

    def write_manifest(self, variant: str | None = None, **facts) -> str:
        """Merges facts into those of the variant, or of the dataset, and stamps id and time."""
        old = self.manifest()
        if variant:
            bundles = old.get("bundles", {})
            old["bundles"] = bundles | {variant: bundles.get(variant, {}) | facts}
        else:
            old |= facts
        old |= {"dataset_id": self.name, "updated": datetime.now(timezone.utc).isoformat()}
        to = storage.join(self.folder, "dataset.json")
        storage.write_text(to, json.dumps(old, indent=1, sort_keys=True))
        return to


def dataset(root: str, value: str) -> Dataset:
    return Dataset(str(root), slug_text(value))


def list_datasets(root: str) -> list[Dataset]:
    """Datasets of the warehouse; folders without a canonical name are passed over."""
    return [Dataset(str(root), name) for name in storage.children(str(root)) if _canonical(name)]


def _canonical(name: str) -> bool:
    try:
        return slug_text(name) == name
    except ValueError:
        return False


def resolve_bundle(root: str, name: str | None, variant: str = "default") -> tuple[Dataset, str]:
    """The named dataset, else the only one that has bundles; never a choice between several."""
    if name:
        found = dataset(root, name)
    else:
        have = [d for d in list_datasets(root) if d.variants()]
        if len(have) != 1:
            raise ValueError(f"{len(have)} datasets have bundles; name one")
        found = have[0]
    if variant not in found.variants():
        raise ValueError(f"{found.name} has no variant {variant}")
    return found, variant


def describe(root: str) -> str:
    return "\n".join(f"{d.name}: {', '.join(d.variants()) or 'no bundle'}" for d in list_datasets(root))


def save_bundle(tables: dict[str, DataFrame], data: Dataset, variant: str, **params) -> str:
    """Writes each table as parquet and the parameters last, so a bundle is whole if they are there."""
    to = data.bundle(variant)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(storage.join(to, name))
    record = params | {"dataset_id": data.name, "variant": variant, "tables": sorted(tables), "created": datetime.now(timezone.utc).isoformat()}
    storage.write_text(storage.join(to, "params.json"), json.dumps(record, indent=1, sort_keys=True, default=str))
    data.write_manifest(variant, **{k: v for k, v in record.items() if k not in ("dataset_id", "variant")})
    return to


def load_bundle(spark: SparkSession, data: Dataset, variant: str = "default") -> dict[str, DataFrame]:
    """All tables of a bundle by name."""
    to = data.bundle(variant)
    record = json.loads(storage.read_text(storage.join(to, "params.json")) or "{}")
    return {name: spark.read.parquet(storage.join(to, name)) for name in record.get("tables", [])}


def polygons_of(bundle: dict[str, DataFrame]) -> DataFrame:
    """cell_id and wkb of every cell of a bundle, whatever order or number its outlines have; null where a cell has none."""
    outlines = bundle["polygons"].groupBy(F.col("cell").alias("cell_id")).agg(F.first("wkb", ignorenulls=True).alias("wkb"))
    return bundle["cells"].select("cell_id").join(outlines, "cell_id", "left")


def write_embeddings(vectors: DataFrame, data: Dataset, name: str, **facts) -> str:
    """Writes vectors (cell_id, embedding) and the facts about them (model, markers, scale) beside, tagged with the dataset; a name that leaves the folder is refused."""
    if "/" in name or os.sep in name or name in ("", ".", ".."):
        raise ValueError(f"no name of a file: {name!r}")
    to = storage.join(data.folder, "embeddings", f"{name}.parquet")
    vectors.select("cell_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(to)
    storage.write_text(storage.join(data.folder, "embeddings", f"{name}.json"), json.dumps(facts | {"dataset": data.name, "created": datetime.now(timezone.utc).isoformat()}, indent=1, sort_keys=True))
    return to


def check_tag(data: Dataset, name: str) -> None:
    """Raises if the vectors of that name are tagged with another dataset; untagged ones pass."""
    facts = json.loads(storage.read_text(storage.join(data.folder, "embeddings", f"{name}.json")) or "{}")
    if facts.get("dataset", data.name) != data.name:
        raise ValueError(f"{name} belongs to {facts['dataset']}, not to {data.name}")


#: Mean and deviation given to a marker that nobody has measured.
NOVEL_MEAN, NOVEL_DEVIATION = 0.0254762, 0.0398634


def register_markers(known: DataFrame, names: list[str], mean: float = NOVEL_MEAN, deviation: float = NOVEL_DEVIATION) -> DataFrame:
    """The marker table with a row for each further name, numbered after the last one, with the usual statistics; names it has already (in any case) stay as they are."""
    have = {r[0] for r in known.select(F.lower("marker_name")).collect()}  # a table of some hundred markers
    last = known.agg(F.coalesce(F.max(F.col("marker_id").cast("int")), F.lit(-1)).alias("m")).collect()[0]["m"]
    fresh = [n for n in dict.fromkeys(names) if n.lower() not in have]
    rows = known.sparkSession.createDataFrame([(n, last + 1 + k, mean, deviation) for k, n in enumerate(fresh)], "marker_name string, marker_id int, marker_mean double, marker_std double")
    base = known.select("marker_name", F.col("marker_id").cast("int").alias("marker_id"), F.col("marker_mean").cast("double").alias("marker_mean"), F.col("marker_std").cast("double").alias("marker_std"))
    return base.unionByName(rows)


def write_report(results: DataFrame, path: str, baseline: str, arm: str, score: str) -> DataFrame:
    """Writes the results with each arm's difference from the baseline arm as CSV and JSON; returns them."""
    base = results.filter(F.col(arm) == baseline).agg(F.max(score).alias("__b"))
    out = results.crossJoin(F.broadcast(base)).withColumn("delta", F.col(score) - F.col("__b")).drop("__b")  # one row
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    out.write.mode("overwrite").json(f"{path}/json")
    return out
