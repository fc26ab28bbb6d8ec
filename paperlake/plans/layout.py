"""Queries of places in papers; orders serve as pages, their items as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators import boxes, layout, vectors
from paperlake.plans.tables import query, table


@query()
def borderless_table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of an order has a line on its left and one on its right; a loop tests it."""
    i = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("paper_id"), F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * (8 + F.col("l_suppkey") % 40) + 30).cast("double").alias("y0"), (F.col("l_partkey") % 30).cast("double").alias("x0"), (F.col("l_quantity") % 25).alias("right"), (F.col("l_partkey") % 5).cast("double").alias("down"))
    box = lambda x, y: i.select("paper_id", "page", x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 8).alias("y1"))
    lines = box(F.col("x0"), F.col("y0")).union(box(F.col("x0") + F.col("right"), F.col("y0") + F.col("down")))
    captions = i.select("paper_id", "page").distinct().select("paper_id", "page", F.lit("tab1").alias("item"), F.lit(20.0).alias("y0"), F.lit(30.0).alias("y1"))
    return layout.borderless_tables(lines, captions)


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as drawings: places and sizes follow from parts, suppliers and amounts; 8 orders
    are a page."""
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    # all columns but l_quantity follow from these; repeated rows go while they are narrow
    li = table(spark, sf_dir, "lineitem").select(*own, "l_quantity").dropDuplicates(own)
    x, y = (F.col("l_partkey") * 37 % 560).cast("double"), (F.col("l_suppkey") * 53 % 760).cast("double")
    w, h = F.when(F.col("l_suppkey") % 97 == 0, 600.0).otherwise(F.col("l_quantity")), F.when(F.col("l_suppkey") % 97 == 0, 1.0).otherwise(F.floor(F.col("l_extendedprice") % 40))
    return li.select(F.lit("p").alias("paper_id"), F.floor(F.col("l_orderkey") / 8).alias("page"), F.struct(*own).alias("box_id"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), F.col("l_linenumber").cast("long").alias("commands"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


@query()
def figure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of a page that lie near each other, as figures; a plain loop tests it."""
    from paperlake.plans.tables import ensure_checkpoints

    ensure_checkpoints(spark)
    return boxes.figures(drawings(spark, sf_dir)).drop("cluster")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Figure 1 (a) left ' || o_custkey || ' (b) right' WHEN 1 THEN 'Tab. 2' WHEN 2 THEN '(A)(c) only ' || o_custkey ELSE NULL END AS caption FROM orders)
SELECT id, CASE id % 4 WHEN 0 THEN 'left ' || substr(caption, 19, length(caption) - 28) || '/right' WHEN 2 THEN substr(caption, 8) ELSE '' END AS parts,
CASE id % 4 WHEN 0 THEN CASE WHEN id % 3 = 0 THEN NULL ELSE 'fig1' END WHEN 1 THEN 'tab2' END AS item FROM c""")
def caption_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    caption = F.when(kind == 0, F.concat(F.lit("Figure 1 (a) left "), n, F.lit(" (b) right"))).when(kind == 1, "Tab. 2").when(kind == 2, F.concat(F.lit("(A)(c) only "), n))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("paper_id"), caption.alias("citation"))
    items = spark.createDataFrame([(1, "fig1"), (2, "FIG1"), (0, "tab2"), (1, "tab2"), (2, "tab2"), (2, "tab2")], "paper_id long, item string")
    return layout.cited_items(rows, items).select("id", F.array_join(layout.caption_parts(F.col("citation")), "/").alias("parts"), "item")


@query("""WITH d AS (SELECT doc_id, text, length(text) // 3 AS n FROM documents), t AS (SELECT doc_id, text, instr(text, trim(substr(text, n + 1, 20), ' ')) AS a, instr(text, trim(substr(text, 2 * n + 1, 20), ' ')) AS b, trim(substr(text, n + 1, 20), ' ') AS x, trim(substr(text, 2 * n + 1, 20), ' ') AS y FROM d),
u AS (SELECT doc_id, text, least(a, b) AS lo, greatest(a, b) AS hi, a <= b AS up FROM t WHERE x <> '' AND y <> '')
SELECT doc_id, 1 AS ord, CASE WHEN up THEN 'method' ELSE 'full' END AS name, CASE WHEN up THEN '1' ELSE '2' END AS sec, md5(regexp_replace(substr(text, 1, hi - 1), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS text_md5 FROM u
UNION ALL SELECT doc_id, 2, CASE WHEN up THEN 'full' ELSE 'method' END, CASE WHEN up THEN '2' ELSE '1' END, md5(regexp_replace(substr(text, hi), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) FROM u""")
def located_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two titles for each text, pieces of it as a model would name them."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.floor(F.length("text") / 3).cast("int"))
    title = lambda k, name: docs.select("doc_id", F.lit(k).alias("no"), F.lit(name).alias("name"), F.lit(str(k)).alias("sec"), F.trim(F.substring("text", F.col("n") * k + 1, F.lit(20))).alias("title"))
    rows = layout.located(docs, title(1, "Methods").union(title(2, "Appendix")), "doc_id")
    return rows.select("doc_id", "ord", "name", "sec", F.md5("text").alias("text_md5"))


@query("""SELECT l_orderkey AS paper_id, l_shipmode AS name, array_to_string(list(s ORDER BY o, s), ',') AS secs FROM (SELECT l_orderkey, CAST(l_returnflag AS VARCHAR) AS l_shipmode, CAST(l_suppkey % 3 AS VARCHAR) AS s, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("name"), (F.col("l_suppkey") % 3).cast("string").alias("sec"), F.col("l_linenumber").alias("ord"))
    return layout.numbers_of_names(parts).withColumn("secs", F.array_join("secs", ","))


@query("""SELECT doc_id, 'By $x_' || doc_id || '$ and ' || CASE WHEN doc_id % 3 = 0 THEN '$$[FORMULA_UNVERIFIED]$$ \\frac ' || doc_id ELSE '$$ y + ' || doc_id || ' $$' END || ', so \\$5.' AS text FROM documents""")
def marked_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula with a backslash counts as one that no parser reads."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("By $x_"), i, F.lit("$ and $$ "), F.when(F.col("doc_id") % 3 == 0, "\\frac ").otherwise("y + "), i, F.lit(" $$, so \\$5."))
    return table(spark, sf_dir, "documents").select("doc_id", layout.marked(text, lambda tex: ~F.contains(tex, F.lit("\\"))).alias("text"))


@query("""WITH l AS (SELECT doc_id, text, coalesce(replace(text, '. ', chr(10)), '') AS p FROM documents), k AS (SELECT doc_id, text, p, list_filter(list_transform(string_split(p, chr(10)), lambda s: trim(s, ' -•' || chr(9))), lambda s: length(s) > 6) AS ks FROM l)
SELECT doc_id, md5(CASE WHEN length(trim(split_part(ltrim(p, E' \\t\\n\\x0B\\f\\r'), chr(10), 1), ' ')) BETWEEN 1 AND 119 THEN trim(split_part(ltrim(p, E' \\t\\n\\x0B\\f\\r'), chr(10), 1), ' ') ELSE CAST(doc_id AS VARCHAR) END) AS title_md5, md5(left(p, 600)) AS summary_md5, md5(array_to_string(list_transform(ks[1:12], lambda s: left(s, 160)), chr(10))) AS points_md5 FROM k""")
def paper_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n")).alias("pass1"))
    got = layout.cards(docs, docs.select("doc_id", F.lit(1).alias("ord"), F.col("pass1").alias("text")), "doc_id")
    return got.select("doc_id", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), F.md5(F.array_join("key_points", "\n")).alias("points_md5"))


@query("""SELECT 'm' || (vec_id % 3) AS model, len(embedding) AS dim, count(*) AS vectors FROM embeddings WHERE NOT (vec_id % 3 = 1 AND label % 2 = 0) GROUP BY 1, 2""")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are left after those of one model and an even label go."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model"), F.col("vec_id").alias("owner_id"), F.col("embedding").alias("vec"), "label")
    return vectors.counts(vectors.deleted(rows, rows.where("label % 2 = 0"), "m1"))
