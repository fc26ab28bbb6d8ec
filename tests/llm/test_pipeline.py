import corpus_pipeline
from paperlake.llm import common


def test_pipeline_keeps_columns_and_clean_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    counts = [docs.count()]
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = common.stored(stage(spark, step, sf_dir), name)
        counts.append(step.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == docs.columns
    assert counts == sorted(counts, reverse=True) and counts[4] == counts[5] > 0.7 * counts[0]
    assert counts[3] < counts[2] and counts[4] < counts[3]


def test_pipeline_of_nothing(spark, sf_dir):
    step = common.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir)
    assert step.count() == 0


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in every column, rows without an id, equal rows, extra columns of clashing names."""
    docs = common.table(spark, sf_dir, "documents")
    some = docs.limit(3).collect()
    rows = [(*r, "x", "y") for r in some] + [(*some[0], "x", "y"), (None, some[1]["text"], None, None, None, None, "y"), (None, None, None, None, None, None, None), (-5, "", "en", "s", 0, "x", "y"), (-6, None, None, None, None, "x", "y")]
    step = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", _key string, _toxic string")
    names = step.columns
    for name, stage in corpus_pipeline.STAGES:
        step = common.stored(stage(spark, step, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == names
    ids = [r["doc_id"] for r in step.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in some}


def test_documents_with_a_short_item_can_stay(spark):
    from paperlake.llm import decontaminate

    docs = spark.createDataFrame([(1, "a word here"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.keep_uncontaminated(docs, items).collect()] == [2]
    assert decontaminate.keep_uncontaminated(docs, items, least_words=2).count() == 2


def test_stages_are_stored_in_small_row_groups(spark):
    """A task holds a whole one while it writes, and again while it reads: with eight tasks and
    groups of 128 MB that is all of a heap of 1 GB."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    ids = spark.range(0, 8000, 1, 1)
    texts = ids.select("id", F.concat_ws("", *[F.sha2(F.concat_ws(" ", "id", F.lit(i)), 512) for i in range(40)]).alias("text"))
    found = common.stored(texts, "texts")
    (file,) = glob.glob(found.inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(file).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 35 << 20 and max(sizes) < 16 << 20
    assert found.where(F.length("text") == 40 * 128).select("id").distinct().count() == 8000
