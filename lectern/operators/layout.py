"""Layout blocks: valid boxes, reading order in columns, figure panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.session import spread


def valid_box(page: Column, bbox: Column) -> Column:
    """Page at least 0 and four coordinates within 0 and 1000 that span an area."""
    inside = (F.size(bbox) == 4) & F.forall(bbox, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1000))
    return F.coalesce((page >= 0) & inside & (F.get(bbox, F.lit(0)) < F.get(bbox, F.lit(2))) & (F.get(bbox, F.lit(1)) < F.get(bbox, F.lit(3))), F.lit(False))


def reading_order(boxes: DataFrame, keys: list[str], ord_col: str = "ord", min_gap: float = 20, min_width: float = 180) -> DataFrame:
    """``boxes (keys, ord, x0, y0, x1, y1)`` with ``col`` and ``pos`` within each run.

    The two columns part at the widest gap between a left and a right set, by x0, if it has
    ``min_gap`` and every box on either side is at least ``min_width`` wide; otherwise there is one.
    """
    boxes = spread(boxes, *keys)
    up = Window.partitionBy(*keys).orderBy("x0", ord_col)
    down = Window.partitionBy(*keys).orderBy(F.col("x0").desc(), F.col(ord_col).desc())
    wide = F.col("x1") - F.col("x0")
    before = up.rowsBetween(Window.unboundedPreceding, 0)
    after = down.rowsBetween(Window.unboundedPreceding, -1)
    cut = boxes.withColumn("__r", F.max("x1").over(before)).withColumn("__wl", F.min(wide).over(before)).withColumn("__l", F.min("x0").over(after)).withColumn("__wr", F.min(wide).over(after)).withColumn("__i", F.row_number().over(up))
    good = (F.col("__l") - F.col("__r") >= min_gap) & (F.col("__wl") >= min_width) & (F.col("__wr") >= min_width)
    best = cut.where(good).groupBy(*keys).agg(F.max_by((F.col("__l") + F.col("__r")) / 2, F.struct((F.col("__l") - F.col("__r")), -F.col("__i"))).alias("__mid"))
    out = boxes.join(best, keys, "left").withColumn("col", F.when(F.col("__mid").isNotNull() & (F.col("x0") >= F.col("__mid")), 1).otherwise(0))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("col", "y0", "x0", ord_col))).drop("__mid")


def panel_pairs(boxes: DataFrame, keys: list[str], id_col: str = "ord") -> DataFrame:
    """``(keys, a, b, layout)``: side-by-side or stacked panels, where each has the other as its only partner.

    The boxes share 80 % of the smaller extent, their sizes differ by a quarter at most, and the gap is -20 to 60.
    """
    boxes = spread(boxes, *keys)
    a = boxes.select(*keys, F.col(id_col).alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select(*keys, F.col(id_col).alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])

    def fits(u: str, v: str) -> Column:
        la, lb = F.col(f"a_{v}1") - F.col(f"a_{v}0"), F.col(f"b_{v}1") - F.col(f"b_{v}0")
        wa, wb = F.col(f"a_{u}1") - F.col(f"a_{u}0"), F.col(f"b_{u}1") - F.col(f"b_{u}0")
        common = F.least(F.col(f"a_{v}1"), F.col(f"b_{v}1")) - F.greatest(F.col(f"a_{v}0"), F.col(f"b_{v}0"))
        gap = F.col(f"b_{u}0") - F.col(f"a_{u}1")
        return (common >= 0.8 * F.least(la, lb)) & (F.least(la, lb) >= 0.75 * F.greatest(la, lb)) & (F.least(wa, wb) >= 0.75 * F.greatest(wa, wb)) & gap.between(-20, 60)

    pairs = a.join(b, keys).where("a <> b").withColumn("layout", F.when(fits("x", "y"), "horizontal").when(fits("y", "x"), "vertical")).where("layout is not null")
    ends = pairs.select(*keys, "a", "b", "layout", F.explode(F.array("a", "b")).alias("p"))
    alone = ends.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "p"))).where("n = 1")
    return alone.groupBy(*keys, "a", "b", "layout").agg(F.count("*").alias("n")).where("n = 2").drop("n")
