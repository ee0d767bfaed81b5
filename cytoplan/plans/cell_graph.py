"""Producing a bundle: cells, outlines, labels and graphs of one slide, as one lazy plan per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import add_outline_gap, as_wkb, contact_edges, polygon_metrics, repaired
from ..operators.alignment import folded_label, left_attach
from ..operators.graph import voronoi_edges

#: Fixed values in µm: gap of contact, and reach of an apposed wall, and the longest candidate edge.
CONTACT_UM, APPOSED_UM, CANDIDATE_UM = 1.0, 1.0, 100.0


def slide_tables(outlines: DataFrame, scale: float, labels: DataFrame | None = None, cells: DataFrame | None = None, tolerance: float = CONTACT_UM) -> dict[str, DataFrame]:
    """cells, polygons, edges_voronoi and edges_contact of a slide.

    outlines: cell_id, xs, ys (pixels); scale: µm a pixel; labels: cell_id, group; cells: cell_id and extra columns. Hopeless outlines drop their cell;
    labels and extra columns attach by cell_id, first row first. Contact candidates are the neighbours of an unclipped diagram up to
    CANDIDATE_UM, so pairs whose common face lies wholly beyond it are not looked at.
    """
    good = repaired(outlines.dropDuplicates(["cell_id"]), "xs", "ys").filter("xs is not null")
    m = good.withColumn("m", polygon_metrics("xs", "ys", F.lit(scale)))
    table = m.select("cell_id", "m.*", (F.col("m.centroid_x") * scale).alias("x_um"), (F.col("m.centroid_y") * scale).alias("y_um"))
    for extra in (cells, labels.withColumnRenamed("group", "cell_group") if labels is not None else None):
        if extra is not None:
            table = left_attach(table, extra, ["cell_id"], [c for c in extra.columns if c != "cell_id"][:1])
    if labels is not None:
        table = table.withColumn("cell_group", folded_label("cell_group"))
    at = table.select(F.lit("slide").alias("space"), "cell_id", "x_um", "y_um")
    voronoi = voronoi_edges(at, "space", "cell_id", "x_um", "y_um")
    near = voronoi_edges(at, "space", "cell_id", "x_um", "y_um", clip=CANDIDATE_UM / 2)
    contact = contact_edges(near, good, "cell_id", "xs", "ys", tolerance, APPOSED_UM, scale)
    return {
        "cells": table,
        "polygons": good.select(F.col("cell_id").alias("cell"), as_wkb("xs", "ys").alias("wkb")),
        "edges_voronoi": add_outline_gap(voronoi.select("i", "j", F.col("face").alias("shared_wall_um"), F.col("distance").alias("centroid_dist_um")), good, "cell_id", "xs", "ys", scale),
        "edges_contact": contact,
    }
