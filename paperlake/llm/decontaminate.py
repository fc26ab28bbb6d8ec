"""Benchmark decontamination: size-partitioned MinHash containment search, then exact checks.

Words are runs of letters and digits of the lower-cased text; shingles are runs of five
words. An item of fewer words is one shingle of all its words. A document contains an item if
it holds at least ``least`` of the item's different shingles, wherever they stand.

Items are partitioned by their number of shingles, [2^k, 2^(k+1)). The signature of an item
is the set of its ``m`` smallest shingle hashes (its bottom-m MinHash), where m follows from
the largest size u of its partition: ``u - ceil(least * u) + 1``. Whoever lacks all of these
lacks more than ``1 - least`` of the item, so a document that contains it shares one of them:
the search loses nothing, however long the document is.

Each partition prunes on its own. A document with fewer shingles than the share ``least`` of
its smallest items can't contain any of them and doesn't ask it; others ask it for hashes up
to the largest in its signatures only, or, if its signatures have few hashes at all (as those
of one-shingle items, which may lie anywhere), for just these. The shingles of the documents
found are then compared as words with those of the items.

Everything is DataFrame operations. Rows of one id (null is an id) are one document or item;
null and empty texts contain nothing and are contained in nothing. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import named_apart, saved

#: Tables of items and candidates up to so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: A partition whose signatures have so many hashes is asked for these by value.
FEW_HASHES = 256


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _grams(n: int, make) -> Column:
    """``make`` of the words of every run of ``n`` words of column _w."""
    w = F.col("_w")
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make([F.get(w, i + k) for k in range(n)])))


def _hashes(n: int) -> Column:
    return _grams(n, lambda ws: F.xxhash64(*ws))


def _lines(n: int) -> Column:
    return _grams(n, lambda ws: F.concat_ws(" ", *ws))


def _all(sizes: list[int], of) -> Column:
    empty = F.array().cast("array<bigint>" if of is _hashes else "array<string>")
    return reduce(lambda a, b: F.concat(a, b), [F.coalesce(of(n), empty) for n in sizes])


def items_of(items: DataFrame, item_id: str, text: str, shingle: int) -> tuple[DataFrame, list[int]]:
    """The different shingles of items, (item_id, n, hash, line, size), and the numbers of
    words in them, at most ``shingle`` of these."""
    w = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    w = w.withColumn("n", F.least(F.size("_w"), F.lit(shingle)))
    sizes = sorted(r["n"] for r in w.select("n").distinct().collect())
    parts = [w.where(F.col("n") == n).select("item_id", "n", F.explode(F.arrays_zip(_hashes(n).alias("hash"), _lines(n).alias("line"))).alias("s")).select("item_id", "n", F.col("s.hash").alias("hash"), F.col("s.line").alias("line")) for n in sizes]
    if not parts:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, n int, hash long, line string, size long"), sizes
    one = reduce(DataFrame.union, parts).distinct()
    totals = one.groupBy("item_id").agg(F.count("*").alias("size"))
    return saved(one.join(totals.withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i")), sizes


def signatures(shingles: DataFrame, least: float) -> DataFrame:
    """(item_id, part, hash): the bottom-m hashes of every item, m set by its partition."""
    part = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    largest = F.pow(F.lit(2.0), F.col("part") + 1).cast("long") - 1
    # containment is counted in whole shingles; a tiny slack keeps ceil() off rounding errors
    m = largest - F.ceil(largest * F.lit(least) - 1e-9) + 1
    sets = shingles.groupBy("item_id", "size").agg(F.array_sort(F.collect_set("hash")).alias("all")).withColumn("part", part)
    return sets.select("item_id", "part", F.explode(F.slice("all", F.lit(1), m.cast("int"))).alias("hash"))


def probes(rows: DataFrame, signed: DataFrame, sizes: list[int], least: float) -> DataFrame:
    """(doc_id, hash): what documents (doc_id, _w) ask the partitions for."""
    parts = signed.groupBy("part").agg(F.max("hash").alias("highest"), F.countDistinct("hash").alias("n")).collect()  # 64 rows at most
    few = [r["part"] for r in parts if r["n"] <= FEW_HASHES]
    values = [r["hash"] for r in signed.where(F.col("part").isin(few)).select("hash").distinct().collect()] if few else []
    hashes = rows.select("doc_id", _all(sizes, _hashes).alias("_h"))
    limit = F.lit(-(1 << 63)).cast("long")
    for r in parts:
        if r["part"] not in few:
            need = -int(-(least * (1 << r["part"]) - 1e-9) // 1)
            limit = F.greatest(limit, F.when(F.size("_h") >= need, F.lit(r["highest"])))
    asked = lambda h: (h <= F.col("_limit")) | h.isin(values) if values else h <= F.col("_limit")
    return hashes.withColumn("_limit", limit).select("doc_id", F.explode(F.filter("_h", asked)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, n_shingles (of the
    item), n_found, containment."""
    shingles, sizes = items_of(items, item_id, text, shingle)
    small = shingles.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda df: df)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    if not sizes:
        return rows.limit(0).crossJoin(shingles.limit(0)).select("doc_id", "item_id", F.col("size").alias("n_shingles"), F.col("size").alias("n_found"), F.lit(0.0).alias("containment"))
    signed = saved(signatures(shingles, least))
    found = probes(rows.select("doc_id", words(F.col("_t")).alias("_w")), signed, sizes, least)
    candidates = saved(found.join(near(signed.select("hash").distinct()), "hash", "left_semi").select(F.col("doc_id").alias("_d")).distinct())
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    # whole documents again, but only those found
    again = rows.join(candidates, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").select("doc_id", words(F.col("_t")).alias("_w"))
    held = again.select("doc_id", F.explode(F.array_distinct(_all(sizes, _lines))).alias("line"))
    known = near(shingles.select("item_id", "line", "size"))
    # rows of one id may hold a shingle twice
    hits = held.join(known, "line").select("doc_id", "item_id", "size", "line").distinct().groupBy("doc_id", "item_id", "size").agg(F.count("*").alias("n_found"))
    return hits.where(F.col("n_found") >= F.ceil(F.col("size") * F.lit(least) - 1e-9)).select("doc_id", "item_id", F.col("size").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("size")).alias("containment"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, least_words: int = 1) -> DataFrame:
    """``docs`` without the documents that contain an item of ``least_words`` words or more. An
    item of one common word would take most documents along: raise ``least_words`` where a
    benchmark has such. Rows of one id go together; columns may have any names."""
    items = items.where(F.size(words(F.col(text))) >= least_words)
    (own,) = named_apart(docs, "_d")
    found = contained(docs, items, doc_id, "item_id", text, shingle, least).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(own)), "left_anti")


#: The same result in DuckDB's SQL, for items of five words or more.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5)),
it AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM it GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN it USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found * 5 >= n_shingles * 4
"""
