"""Places in papers against plain loops, with empty and odd rows."""

from paperlake.operators import layout, vectors
from paperlake.plans import QUERIES
from paperlake.plans.tables import table
from pyspark.sql import functions as F


def region(lines: list[tuple], top: float):
    """(x0, y0, y1) lines; the bottom of the table under a caption that ends at ``top``."""
    rows: list[list[tuple]] = []
    for y0, x0, y1 in sorted((y0, x0, y1) for x0, y0, y1 in lines if top - 1 <= y0 < top + 500):
        mid = (y0 + y1) / 2
        if rows and abs(mid - (rows[-1][0][0] + rows[-1][0][2]) / 2) <= 3:
            rows[-1].append((y0, x0, y1))
        else:
            rows.append([(y0, x0, y1)])
    last, bottom = None, None
    for row in rows:
        xs = sorted(x for _, x, _ in row)
        if not any(b - a >= 12 for a, b in zip(xs, xs[1:])):
            continue
        mid = sum((a + c) / 2 for a, _, c in row) / len(row)
        if (min(row)[0] - top > 180) if last is None else (mid - last > 80):
            break
        last, bottom = mid, max(bottom or 0, max(c for _, _, c in row) + 3)
    return bottom


def test_borderless_regions_equal_a_loop(spark, sf_dir):
    got = {r["page"]: r["bottom"] for r in QUERIES["borderless_table_regions"](spark, sf_dir).collect()}
    pages: dict[int, list] = {}
    for r in table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity").collect():
        y, x = r["l_linenumber"] * (8 + r["l_suppkey"] % 40) + 30.0, r["l_partkey"] % 30.0
        pages.setdefault(r["l_orderkey"], []).extend([(x, y, y + 8), (x + r["l_quantity"] % 25, y + r["l_partkey"] % 5, y + r["l_partkey"] % 5 + 8)])
    want = {p: b for p, b in ((p, region(ls, 30.0)) for p, ls in pages.items()) if b is not None}
    assert got == want and 0 < len(want) <= len(pages)


def test_odd_rows(spark):
    texts = spark.createDataFrame([("a", "Intro here. Method there. End."), ("b", "Intro only"), ("c", None), ("d", "")], "paper_id string, text string")
    titles = spark.createDataFrame([(p, i, n, None, t) for p in "abcd" for i, n, t in ((0, "intro", "Intro"), (1, "THEORY", "Method"), (2, "other", " "), (3, "x", None))], "paper_id string, no int, name string, sec string, title string")
    got = [tuple(r) for r in layout.located(texts, titles).orderBy("paper_id", "ord").collect()]
    assert got == [("a", 1, "intro", "0", "Intro here."), ("a", 2, "method", "1", "Method there. End.")]
    one = spark.createDataFrame([(None,), ("",), ("(a)x (g) (F)y",)], "c string").select(layout.caption_parts(F.col("c")), layout.marked(F.col("c"), lambda t: F.lit(None).cast("boolean"))).collect()
    assert [tuple(r) for r in one] == [([], ""), ([], ""), (["x (g)", "y"], "(a)x (g) (F)y")]
    none = spark.createDataFrame([], "paper_id string, page int, item string, x0 double, y0 double, x1 double, y1 double")
    assert layout.borderless_tables(none.drop("item"), none.drop("x0", "x1")).count() == 0
    v = spark.createDataFrame([("m", 1, [1.0]), ("m", 2, None), (None, 1, [])], "model string, owner_id int, vec array<double>")
    dead = spark.createDataFrame([(1,), (1,), (None,)], "owner_id int")
    assert {tuple(r) for r in vectors.counts(vectors.deleted(v, dead, "m")).collect()} == {("m", 0, 1), (None, 0, 1)}
    assert vectors.deleted(v, dead).count() == 1
