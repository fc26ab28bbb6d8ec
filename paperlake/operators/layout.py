"""Places in papers: table regions under captions, parts of captions, sections at given titles,
cited items, marked formulas, cards of papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.text import blank
from paperlake.operators.common import top
from paperlake.operators.documents import FORMULA, tex_of

# fixed values: names of sections and what other names stand for
NAMES = ["abstract", "intro", "method", "experiments", "conclusion", "full"]
STANDS_FOR = {"methods": "method", "theory": "method", "results": "experiments", "discussion": "experiments", "other": "full"}
UNVERIFIED = "$$[FORMULA_UNVERIFIED]$$ "


def borderless_tables(lines: DataFrame, captions: DataFrame, reach: float = 500.0, first: float = 180.0, gap: float = 80.0) -> DataFrame:
    """(paper_id, page, item, top, bottom) of tables without rules, one under each caption
    (paper_id, page, item, y0, y1) that has one, from text lines (paper_id, page, x0, y0, x1, y1).

    Lines within 3 points of the centre of a row's first line are that row; a row with two
    columns at least 12 points apart is of a table. The first such row is at most ``first``
    below its caption; the run ends before the first step of more than ``gap`` between centres.
    Captions without such rows have no row; a page's lines meet in one task."""
    key = ["paper_id", "page", "item"]
    c = captions.select(*key, F.col("y1").alias("top"))
    near = lines.join(c, ["paper_id", "page"]).where((F.col("y0") >= F.col("top") - 1) & (F.col("y0") < F.col("top") + reach))
    num = lambda x: F.col(x).cast("double").alias(x)
    page = near.groupBy(*key, "top").agg(F.array_sort(F.collect_list(F.struct(num("y0"), num("x0"), num("y1")))).alias("ls"))
    centre = lambda s: (s["y0"] + s["y1"]) / 2

    def step(state: Column, s: Column) -> Column:
        new = ~F.coalesce(F.abs(centre(s) - state["c"]) <= 3.0, F.lit(False))
        n = state["n"] + new.cast("int")
        return F.struct(F.when(new, centre(s)).otherwise(state["c"]).alias("c"), n.alias("n"), F.concat(state["at"], F.array(n)).alias("at"))

    start = F.struct(F.lit(None).cast("double").alias("c"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    at = F.aggregate("ls", start, step, lambda s: s["at"])
    rows = page.select(*key, "top", F.explode(F.arrays_zip("ls", at.alias("at"))).alias("z")).select(*key, "top", F.col("z.at").alias("n"), "z.ls.*")
    row = rows.groupBy(*key, "top", "n").agg(F.array_sort(F.collect_list("x0")).alias("xs"), F.min("y0").alias("y0"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("centre"), F.max("y1").alias("y1"))
    steps = F.zip_with("xs", F.slice("xs", 2, F.size("xs")), lambda a, b: b - a)
    row = row.where(F.exists(steps, lambda d: F.coalesce(d >= 12.0, F.lit(False))))
    by = Window.partitionBy(*key).orderBy("n")
    row = row.withColumn("far", F.coalesce(F.col("centre") - F.lag("centre").over(by) > gap, F.col("y0") - F.col("top") > first))
    row = row.withColumn("past", F.max("far").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("not past")
    return row.groupBy(*key, "top").agg((F.max("y1") + 3.0).alias("bottom"))


def caption_parts(caption: Column) -> Column:
    """What follows ``(a)`` to ``(f)`` in a caption, without the empty ones; null has none."""
    parts = F.slice(F.split(blank(caption), r"(?i)\([a-f]\)"), 2, 1 << 30)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def section_name(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("full")))
    for other, plain in STANDS_FOR.items():
        low = F.when(low == other, plain).otherwise(low)
    return F.when(low.isin(NAMES), low).otherwise("full")


def located(texts: DataFrame, titles: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """(key, ord, name, sec, text): whole texts cut at the first occurrence of given titles
    (key, no, name, sec, title), such as a model's. The first section begins with the text; of
    titles at one place the earlier gives an empty section. Empty titles and those not found
    don't count; under two found ones a paper has no row, so that rules cut it."""
    t = texts.select(key, F.col(text).alias("_t"))
    rows = titles.where(F.trim(blank(F.col("title"))) != "").join(t, key).withColumn("at", F.instr("_t", F.trim("title"))).where("at > 0")
    by = Window.partitionBy(key).orderBy("at", "no")
    rows = rows.select(key, "name", "sec", "at", "_t", F.row_number().over(by).alias("ord"), F.lead("at").over(by).alias("nxt"), F.count("*").over(Window.partitionBy(key)).alias("n")).where("n >= 2")
    begin = F.when(F.col("ord") == 1, 1).otherwise(F.col("at"))
    body = F.substring("_t", begin, F.coalesce("nxt", F.length("_t") + 1) - begin)
    return rows.select(key, "ord", section_name(F.col("name")).alias("name"), F.coalesce("sec", (F.col("ord") - 1).cast("string")).alias("sec"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))


def numbers_of_names(parts: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, name, secs): the different numbers of the sections of a name, in their order."""
    first = parts.groupBy(key, "name", "sec").agg(F.min("ord").alias("ord"))
    return first.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sec"))), lambda s: s["sec"]).alias("secs"))


def cited_item(citation: Column) -> Column:
    """``fig3`` or ``tab2a`` of a citation that names one, figures first; else the citation in
    lower case, which may be an id."""
    c = blank(citation)
    fig = F.lower(F.regexp_extract(c, r"(?i)(?:\b(?:figure|fig)|图)\.?\s*([0-9]+[a-z]?)", 1))
    tab = F.lower(F.regexp_extract(c, r"(?i)(?:\b(?:table|tab)|表)\.?\s*([0-9]+[a-z]?)", 1))
    return F.when(fig != "", F.concat(F.lit("fig"), fig)).when(tab != "", F.concat(F.lit("tab"), tab)).otherwise(F.lower(F.trim(c)))


def cited_items(citations: DataFrame, items: DataFrame, citation: str = "citation") -> DataFrame:
    """``citations`` (paper_id, citation, ...) and item: the one of ``items`` (paper_id, item) it
    names in its paper, else null. Items may repeat."""
    known = items.select("paper_id", F.lower("item").alias("item")).distinct().withColumn("_known", F.lit(True))
    rows = citations.withColumn("item", cited_item(F.col(citation))).join(known, ["paper_id", "item"], "left")
    return rows.withColumn("item", F.when(F.col("_known"), F.col("item"))).drop("_known")


def marked(text: Column, good: Callable[[Column], Column], most: int = 200) -> Column:
    """``text`` with a mark and the first ``most`` characters in the place of every formula that
    ``good`` (of its TeX, 500 characters at most) does not accept; null gives ''."""
    t = blank(text)
    show = lambda m: F.when(F.coalesce(good(F.left(tex_of(m), F.lit(500))), F.lit(False)), m).otherwise(F.concat(F.lit(UNVERIFIED), F.left(tex_of(m), F.lit(most))))
    found = F.transform(F.regexp_extract_all(t, F.lit(FORMULA), F.lit(0)), show)
    return F.array_join(F.zip_with(F.split(t, FORMULA, -1), found, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def cards(papers: DataFrame, parts: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, title, summary, key_points) of papers (key, pass1) with sections (key, ord, text).
    The title is the first line of the first section whose first line is under 120
    characters, else the key; points are the lines of pass1 over 6 characters, 12 of up to
    160 characters; the summary is its first 600."""
    head = F.trim(F.split_part(F.regexp_replace(blank(F.col("text")), r"^\s+", ""), F.lit("\n"), F.lit(1)))
    heads = parts.select(key, "ord", head.alias("title")).where((F.length("title") > 0) & (F.length("title") < 120))
    lines = F.transform(F.split(blank(F.col("pass1")), "\n"), lambda s: F.regexp_replace(s, "^[ \\-•\t]+|[ \\-•\t]+$", ""))
    points = F.slice(F.transform(F.filter(lines, lambda s: F.length(s) > 6), lambda s: F.left(s, F.lit(160))), 1, 12)
    rows = papers.join(top(heads, [key], [F.asc("ord"), F.asc("title")], 1).select(key, "title"), key, "left")
    return rows.select(key, F.coalesce("title", F.col(key).cast("string")).alias("title"), F.left(blank(F.col("pass1")), F.lit(600)).alias("summary"), points.alias("key_points"))
