"""Every registered query runs; those with SQL equal DuckDB's result."""

import math
import os

import duckdb
import pandas as pd
import pytest

import paperlake.plans as plans


def shape(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([str(x) for x in v])
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shape(got) == shape(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs_without_sql(spark, sf_dir, name):
    rows = plans.QUERIES[name](spark, sf_dir)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_sentence_spans_cut_exactly(spark, sf_dir):
    from paperlake.plans.tables import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = plans.QUERIES["sentence_spans"](spark, sf_dir).collect()
    assert len(rows) > len(texts)
    for r in rows:
        assert len(texts[r["doc_id"]][r["start"] : r["end"]].strip()) == r["n"]


def test_mmr_equals_a_loop(spark):
    from paperlake.operators import ranking

    pool = [("q", i, i, ["a", "b", str(i % 3)]) for i in range(8)]
    got = [r["k"] for r in ranking.mmr(spark.createDataFrame(pool, "q string, k int, position int, keywords array<string>"), "q", "k", 4).orderBy("rank").collect()]
    left, taken = list(pool), []
    while left and len(taken) < 4:
        gains = [0.7 / (1 + x[2]) - 0.3 * max((len({*x[3]} & {*t[3]}) / len({*x[3]} | {*t[3]}) for t in taken), default=0) for x in left]
        taken.append(left.pop(gains.index(max(gains))))
    assert got == [t[1] for t in taken]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
