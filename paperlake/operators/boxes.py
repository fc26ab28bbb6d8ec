"""Boxes on pages: clusters of near ones, gates of figures and sub-figures.

Boxes are near if, widened by half a gap on each side, they overlap. A grid finds connections
without comparing pairs: a widened box is wider and higher than a grid step, so two that overlap
hold a common grid point, or hold neighbouring points, or one's corner lies in the same cell as
the other's opposite corner. Boxes of a point are hung on one of them; of neighbouring points
the farthest-reaching boxes are compared; the corners in a cell are swept in one order. So the
connections found grow with the boxes, however many lie on one place, and join the same boxes
as all pairs would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.common import kept
from paperlake.operators.graph import components

EDGES = ["x0", "y0", "x1", "y1"]


def drawn(boxes: DataFrame) -> DataFrame:
    """``boxes`` (paper_id, page, box_id, x0..y1, commands, and width and height of the page)
    without frames around whole pages, rules across them and dots. Boxes with null edges or
    turned ones go too."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    frame = (w > 0.92 * F.col("width")) & (h > 0.92 * F.col("height"))
    rule = (h <= 1.5) & (w > 0.65 * F.col("width"))
    return boxes.where((w >= 0) & (h >= 0) & ~frame & ~rule & ~((w <= 1.0) & (h <= 1.0)))


def named(page: list[str]) -> Column:
    """One text for a box; a page's null column is left out of it."""
    return F.to_json(F.struct(*page, "box_id"))


def touching(boxes: DataFrame, gap: float, page: list[str], name: Column | None = None) -> DataFrame:
    """(src, dst) over boxes, each named by ``name`` (else by ``page`` and box_id: ``named``),
    whose components are those of all pairs on a page that overlap when widened by half a
    ``gap``. A name is held for each grid point of a box, so a short one spares most of the disk."""
    half, step = gap / 2.0, gap * 0.96
    b = boxes.select(*page, (named(page) if name is None else name).alias("n"), (F.col("x0") - half).alias("x0"), (F.col("y0") - half).alias("y0"), (F.col("x1") + half).alias("x1"), (F.col("y1") + half).alias("y1"))
    cell = lambda c: F.floor(F.col(c) / step).cast("long")
    # points strictly inside
    first, last = (lambda c: cell(c) + 1), (lambda c: F.ceil(F.col(c) / step).cast("long") - 1)
    points = b.select("*", F.explode(F.sequence(first("x0"), last("x1"))).alias("i")).select("*", F.explode(F.sequence(first("y0"), last("y1"))).alias("j"))
    at = [*page, "i", "j"]
    far = points.groupBy(*at).agg(F.min("n").alias("n"), *[f(F.struct(F.col(c).alias("v"), "n")).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    hung = points.select(*at, F.col("n").alias("dst")).join(far.select(*at, F.col("n").alias("src")), at).select("src", "dst")

    def beside(i: int, j: int, end: str, begin: str) -> DataFrame:
        nxt = far.select(*page, (F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), F.col(begin).alias("_b"))
        return far.select(*at, F.col(end).alias("_a")).join(nxt, at).where("_a.v > _b.v").select(F.col("_a.n").alias("src"), F.col("_b.n").alias("dst"))

    def swept(xa: str, ya: str, xb: str, yb: str, sign: int) -> DataFrame:
        """Corners (xa, ya) of some boxes and (xb, yb) of others in a cell, where the first box
        begins left of the second's corner, and above or below it."""
        corner = lambda x, y, kind: b.select(*page, cell(x).alias("i"), cell(y).alias("j"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(kind).alias("k"), "n")
        rows = corner(xa, ya, 1).union(corner(xb, yb, 0))
        # those that end farther right come before; of equal ones the other box first
        w = Window.partitionBy(*at).orderBy(F.desc("x"), "k").rowsBetween(Window.unboundedPreceding, 0)
        best = F.max(F.when(F.col("k") == 1, F.struct((sign * F.col("y")).alias("v"), "n"))).over(w)
        return rows.withColumn("_a", best).where((F.col("k") == 0) & (F.col("_a.v") > sign * F.col("y"))).select(F.col("_a.n").alias("src"), F.col("n").alias("dst"))

    parts = [hung, beside(1, 0, "x1", "x0"), beside(0, 1, "y1", "y0"), swept("x1", "y1", "x0", "y0", 1), swept("x1", "y0", "x0", "y1", -1)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.where("src <> dst").distinct()


def clustered(boxes: DataFrame, gap: float = 35.0, page: tuple[str, ...] = ("paper_id", "page")) -> DataFrame:
    """``boxes`` with ``cluster``: the smallest box_id that near boxes of a page lead to."""
    by = list(page)
    # numbers stay as they are once they are written
    rows = kept(boxes.withColumn("_n", F.monotonically_increasing_id()), "boxes")
    c = components(touching(rows, gap, by, F.col("_n")))
    rows = rows.join(c.select(F.col("node").alias("_n"), F.col("component").alias("_c")), "_n", "left").withColumn("_c", F.coalesce("_c", "_n"))
    least = rows.groupBy("_c").agg(F.min("box_id").alias("cluster"))
    return rows.join(least, "_c").drop("_n", "_c")


def extent(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x0, y0, x1, y1, boxes, commands) of groups of boxes."""
    sides = [f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    return boxes.groupBy(*by).agg(*sides, F.count("*").alias("boxes"), F.sum("commands").alias("commands"))


def figures(boxes: DataFrame, gap: float = 35.0) -> DataFrame:
    """(paper_id, page, cluster, x0..y1, boxes, commands): clusters of drawings that are large
    enough to be figures."""
    c = extent(clustered(drawn(boxes), gap), ["paper_id", "page", "cluster"])
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    many = (F.col("commands") >= 5) & (w >= 50) & (h >= 40) & (w * h >= 2500)
    return c.where(many | ((F.col("commands") >= 3) & (w * h >= 8000) & (w >= 70) & (h >= 50)))


def labels(caption: Column) -> Column:
    """The sub-figure labels of a caption: a letter or digit in brackets, repeats counted."""
    return F.regexp_extract_all(F.coalesce(caption, F.lit("")), F.lit(r"\(([a-zA-Z\d])\)"), F.lit(1))


def sub_figures(boxes: DataFrame, captions: DataFrame, gap: float = 12.0, least: float = 30.0) -> DataFrame:
    """(paper_id, page, cluster, no, label, x0..y1, verdict) of figures (rows of ``clustered``
    boxes) with captions (paper_id, page, cluster, caption). A figure whose parts, near boxes
    within it of ``least`` on both sides, are as many as its labels (two or more) is cut into
    them, in reading order; with another number it stays one for a reviewer ("manual"), with
    fewer labels one part ("whole")."""
    key = ["paper_id", "page", "cluster"]
    asked = captions.select(*key, labels(F.col("caption")).alias("labels"))
    own = boxes.join(asked.where(F.size("labels") >= 2).select(*key), key, "left_semi")
    parts = extent(clustered(own.withColumnRenamed("cluster", "_figure"), gap, ("paper_id", "page", "_figure")).withColumnRenamed("cluster", "part").withColumnRenamed("_figure", "cluster"), [*key, "part"])
    parts = parts.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    found = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.bround(F.col("y0") / 50.0, 0).alias("line"), "x0", "y0", "x1", "y1", "part"))).alias("parts"))
    rows = asked.join(found, key, "left").join(extent(boxes, key).select(*key, *EDGES), key)
    cut = F.size("labels") == F.size(F.coalesce("parts", F.array().cast(found.schema["parts"].dataType)))
    verdict = F.when(F.size("labels") < 2, "whole").when(cut, "cut").otherwise("manual")
    one = F.array(F.struct(F.lit(None).cast("string").alias("label"), *EDGES))
    each = F.zip_with("labels", "parts", lambda l, p: F.struct(l.alias("label"), *[p[c].alias(c) for c in EDGES]))
    rows = rows.withColumn("verdict", verdict).select(*key, "verdict", F.posexplode(F.when(F.col("verdict") == "cut", each).otherwise(one)).alias("no", "s"))
    return rows.select(*key, "no", "s.*", "verdict")
