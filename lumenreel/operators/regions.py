"""Rectangles on a source: what is already remembered, and suppression by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rect_overlap
from .selection import suppress

BOX = ("x", "y", "w", "h")


def regions_of_parts(part: DataFrame) -> DataFrame:
    """Parts as rectangles: (id, source_id, x, y, w, h)."""
    p = F.col("p_partkey")
    return part.select(p.alias("id"), (p % 50).alias("source_id"), (p % 83 * 1.0).alias("x"), (p % 47 * 1.0).alias("y"), (p % 29 + 5.0).alias("w"), (p % 23 + 5.0).alias("h"))


#: Side of the cells in which rectangles are looked for.
CELL = 100.0


def _cells(boxes: DataFrame) -> DataFrame:
    """A row for each cell that a rectangle touches."""
    across = F.sequence(F.floor(F.col("x") / CELL), F.floor((F.col("x") + F.col("w")) / CELL))
    down = F.sequence(F.floor(F.col("y") / CELL), F.floor((F.col("y") + F.col("h")) / CELL))
    return boxes.withColumn("cell_x", F.explode(across)).withColumn("cell_y", F.explode(down))


def known_region_anti(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Sources whose proposals aren't all known already, with how many are new. Proposals meet known regions of their
    source in the cells of a grid; equal known regions count once."""
    mine, theirs = tuple(F.col(c) for c in BOX), tuple(F.col(f"o_{c}") for c in BOX)
    other = known.select("source_id", *BOX).distinct().select("source_id", *(F.col(c).alias(f"o_{c}") for c in BOX))
    other = _cells(other.select("source_id", *(F.col(f"o_{c}").alias(c) for c in BOX), *(f"o_{c}" for c in BOX))).drop(*BOX)
    seen = _cells(proposed).join(other, ["source_id", "cell_x", "cell_y"]).filter(rect_overlap(mine, theirs)).select("id").distinct().withColumn("seen", F.lit(True))
    new = proposed.join(seen, "id", "left").groupBy("source_id").agg(F.count_if(F.col("seen").isNull()).alias("new"))
    return new.filter("new > 0")


def _meet(threshold: float):
    """Whether two rectangles (x0, x1, y0, y1) share a threshold of the smaller one's area."""

    def conflict(a: tuple, b: tuple) -> bool:
        w, h = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
        return w > 0 and h > 0 and w * h / min((a[1] - a[0]) * (a[3] - a[2]), (b[1] - b[0]) * (b[3] - b[2])) >= threshold

    return conflict


def merge_regions(regions: DataFrame, threshold: float = 0.30, width: float = 1000.0) -> DataFrame:
    """Regions kept by priority, then id: one goes if it overlaps a kept one of its source by the threshold or more."""
    placed = regions.withColumns({"__x1": F.col("x") + F.col("w"), "__y1": F.col("y") + F.col("h")})
    return suppress(placed, "source_id", [F.col("priority"), F.col("id")], [("x", "__x1"), ("y", "__y1")], _meet(threshold), width).drop("__x1", "__y1")
