"""Sources: papers as files, JSON artefacts, tables, OCR words; all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.text import safe_name, sanitize

TEXT_SUFFIXES = ["txt", "md"]


def papers(spark: SparkSession, path: str, pattern: str = "*", least: int = 10, most: int = 20 << 20) -> DataFrame:
    """(paper_id, path, suffix, sha256, route, content, problem) of the files under ``path``.
    Text is decoded with replacement characters and sanitised; PDF files have the route
    ``pdf`` and no content (an adapter fills it); other kinds and sizes have a ``problem``.
    Equal names are told apart by a hash of their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    base = safe_name(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    problem = F.when(~suffix.isin(*TEXT_SUFFIXES, "pdf"), "suffix").when((F.col("length") < least) | (F.col("length") > most), "size")
    is_text = suffix.isin(TEXT_SUFFIXES) & problem.isNull()
    rows = files.select("path", suffix.alias("suffix"), F.sha2("content", 256).alias("sha256"), base.alias("base"), problem.alias("problem"), F.when(is_text, sanitize(F.decode(F.col("content"), "UTF-8"))).alias("content"), F.when(is_text, "standard").when(suffix == "pdf", "pdf").alias("route"))
    twice = F.count("*").over(Window.partitionBy("base")) > 1
    return rows.select(F.when(twice, F.concat_ws("_", "base", F.left(F.sha2("path", 256), F.lit(8)))).otherwise(F.col("base")).alias("paper_id"), "path", "suffix", "sha256", "route", "content", "problem")


def pages_quality(pages: DataFrame) -> DataFrame:
    """(paper_id, rate, route, low_pages) of PDF pages (paper_id, page, text, n_text_blocks,
    n_image_blocks, ruled_missing)."""
    seen = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    rate = F.least(F.lit(1.0), seen / 40.0) * F.coalesce(F.try_divide(F.col("n_text_blocks"), F.col("n_text_blocks") + F.col("n_image_blocks")), F.lit(0.0))
    rows = pages.withColumn("rate", rate).groupBy("paper_id").agg(F.avg("rate").alias("rate"), F.bool_or("ruled_missing").alias("missing"), F.array_sort(F.collect_set(F.when((F.col("rate") < 0.7) | F.col("ruled_missing"), F.col("page")))).alias("low_pages"))
    route = F.when(F.col("rate") > 0.9, F.when(F.col("missing"), "hybrid").otherwise("standard")).when(F.col("rate") >= 0.5, "hybrid").otherwise("deep_ocr")
    return rows.select("paper_id", "rate", route.alias("route"), "low_pages")


def _page(df: DataFrame) -> list[str]:
    """What tells pages apart: the page, and the paper if the table has one."""
    return [c for c in ("paper_id", "page") if c in df.columns]


def ocr_pages(words: DataFrame) -> DataFrame:
    """(paper_id if there is one, page, text, confidence) of OCR words (page, no, block, par,
    line, conf, word): a new line starts where block, paragraph or line changes."""
    key = _page(words)
    by = Window.partitionBy(*key).orderBy("no")
    place = F.struct("block", "par", "line")
    rows = words.where("word is not null and trim(word) <> ''").withColumn("_new", F.lag(place).over(by).isNotNull() & ~F.lag(place).over(by).eqNullSafe(place))
    piece = F.concat(F.when(F.col("_new"), "\n").when(F.lag("no").over(by).isNull(), "").otherwise(" "), F.trim("word"))
    rows = rows.withColumn("piece", piece)
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece"))), lambda s: s["piece"]), "").alias("text"), (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"))


def ocr_accepted(pages: DataFrame, least_pages: float = 0.9, least: float = 0.5) -> DataFrame:
    """(paper_id, pages, read, confidence, accepted): a paper's OCR counts if ``least_pages`` of
    its pages gave text and their mean confidence is ``least``."""
    seen = F.trim(F.coalesce("text", F.lit(""))) != ""
    g = pages.groupBy("paper_id").agg(F.count("*").alias("pages"), F.count_if(seen).alias("read"), F.avg(F.when(seen, F.coalesce("confidence", F.lit(0.0)))).alias("confidence"))
    return g.withColumn("accepted", (F.col("read") >= least_pages * F.col("pages")) & (F.coalesce("confidence", F.lit(0.0)) >= least))


def captions(lines: DataFrame) -> DataFrame:
    """(paper_id if there is one, page, no, item, caption): lines that begin with a figure or
    table number; a punctuated one displaces bare ones of the same item on its page."""
    from paperlake.functions.text import normal_item

    pattern = r"(?i)^\s*((?:fig(?:ure)?|tab(?:le)?)\.?\s*\d+|[图表]\s*\d+)\s*([.:：|]?)\s*(.*)$"
    rows = lines.withColumn("head", F.regexp_extract("line", pattern, 1)).where("head <> ''")
    rows = rows.withColumn("item", normal_item(F.regexp_replace("head", r"\.", " "))).withColumn("strong", F.regexp_extract("line", pattern, 2) != "")
    return rows.withColumn("any", F.max("strong").over(Window.partitionBy(*_page(lines), "item"))).where(F.col("strong") | ~F.col("any")).select(*_page(lines), "no", "item", F.trim("line").alias("caption"))


def nearest_captions(boxes: DataFrame, captions_: DataFrame, farthest: float = 180.0) -> DataFrame:
    """(paper_id if there is one, page, box_id, item): for each box (page, box_id, x0, y0, x1, y1) the caption (page, item,
    x0..y1) of the least gap + 120 (1 - overlap) + .05 centre distance on its page."""
    key = _page(boxes)
    c = captions_.select(*key, "item", *[F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])
    gap = F.greatest(F.lit(0.0), F.col("cy0") - F.col("y1"), F.col("y0") - F.col("cy1"))
    width = F.least(F.col("x1") - F.col("x0"), F.col("cx1") - F.col("cx0"))
    share = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.least("x1", "cx1") - F.greatest("x0", "cx0")), width), F.lit(0.0))
    centre = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("cx0") + F.col("cx1")) / 2)
    rows = boxes.join(c, key).withColumn("cost", gap + 120 * (1 - share) + 0.05 * centre).where(gap <= farthest)
    return rows.groupBy(*key, "box_id").agg(F.min_by("item", F.struct("cost", "item")).alias("item"))


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str, unique: str | None = None) -> DataFrame:
    """JSON artefacts; broken records have nulls. ``unique``: an id that may not repeat."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    if unique:
        n = F.count("*").over(Window.partitionBy(unique))
        rows = rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{unique} repeats"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")
    return rows
