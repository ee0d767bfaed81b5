"""Names: slugs, labels and lists as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: endings that a slug drops, again and again.
_ENDING = r"(?i)(\.tar\.gz|\.tgz|\.tar|\.zip|_xrrun|_outs)$"
#: Names carry at most this many endings; more are left as they are.
_ROUNDS = 6


def slug(path: str | Column) -> Column:
    """Canonical id of a path: its leaf (the parent's if that is outs) without known endings, lower case, other characters as single underscores; null if nothing is left."""
    c = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    leaf = F.element_at(parts, -1)
    name = F.when((F.size(parts) > 1) & (F.lower(leaf) == "outs"), F.element_at(parts, -2)).otherwise(leaf)
    for _ in range(_ROUNDS):
        name = F.regexp_replace(name, _ENDING, "")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(name != "", name)


def slug_text(path: str) -> str:
    """slug() for one name on the driver; raises if nothing is left."""
    parts = [p for p in str(path).split("/") if p]
    name = parts[-2] if len(parts) > 1 and parts[-1].lower() == "outs" else (parts or [""])[-1]
    for _ in range(_ROUNDS):
        name = re.sub(_ENDING, "", name)
    name = re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")
    if not name:
        raise ValueError(f"no name in {path!r}")
    return name


def cluster_label(number: str | Column) -> Column:
    """Cluster-<n>; null stays null."""
    c = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit("Cluster-"), c.cast("int").cast("string"))


def short(text: str | Column, width: int) -> Column:
    """Text cut to width characters, the last an ellipsis."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def listed(text: str | Column) -> Column:
    """Comma-separated parts without blanks, empty ones left out."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
