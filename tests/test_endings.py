"""Remembered answers, endings of runs, markers."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.operators import budget, finalize, memory, remembered


def test_answers_are_asked_for_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(contents):
        import os
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(f"{a}|{b}" for a, b in contents))
        if any(b == "breaks" for _, b in contents):
            raise RuntimeError
        return [None if a == "fails" else float(len(a) + len(b)) for a, b in contents]

    def asked():
        out = sorted(x for f in log.iterdir() for x in f.read_text().split("\n") if x)
        for f in log.iterdir():
            f.unlink()
        return out

    rows = spark.createDataFrame([(1, "a", "b"), (2, " a ", "b"), (3, "aa", "b"), (4, None, "b"), (5, "", "b"), (6, "fails", "b"), (7, "a", "b")], "id int, claim string, source string").coalesce(1)
    run = lambda df, cache, **k: remembered.recalled(df, cache, ["claim", "source"], ask, "score", T.DoubleType(), **{"model": "m", **k})
    got, cache = run(rows, None)
    scores = {r["id"]: r["score"] for r in got.collect()}
    # equal but for white space around them: one of them was asked for
    assert scores[1] == scores[2] == scores[7] in (2.0, 4.0) and [scores[i] for i in (3, 4, 5, 6)] == [3.0, None, None, None]
    assert len(asked()) == 3
    more = rows.union(spark.createDataFrame([(8, "new", "b")], rows.schema)).coalesce(1)
    got, cache = run(more, cache)
    assert asked() == ["fails|b", "new|b"] and {r["id"]: r["score"] for r in got.collect()}[8] == 4.0
    run(more, cache, model="other")
    assert len(asked()) == 4
    broken = rows.withColumn("source", F.lit("breaks"))
    assert run(broken, cache)[0].where("score is not null").count() == 0 and run(rows.limit(0), None)[0].count() == 0


def test_steps_stand_for_themselves(spark):
    def fails(_):
        raise RuntimeError("x" * 500)

    one = spark.range(3)
    tables, log = finalize.finalized(spark, [("a", lambda _: one), ("b", fails), ("c", lambda t: t["a"].union(t["given"])), ("d", lambda t: t["b"]), ("e", lambda t: t["c"].where(F.raise_error(F.lit("late")).isNull()))], {"given": one})
    got = {r["step"]: (r["rows"], r["error"]) for r in log.collect()}
    assert got["a"] == (3, None) and got["b"] == (None, "x" * 120) and got["c"] == (6, None) and got["d"] == (None, "needs 'b'")
    assert got["e"][0] is None and "late" in got["e"][1] and set(tables) == {"given", "a", "c"}
    notes = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("__field__",), ("p3",)], "paper_id string")
    assert tuple(finalize.field_due(notes, 0).first()) == (3, True) and tuple(finalize.field_due(notes, 1).first()) == (3, False)


def test_markers_and_entries(spark):
    runs = spark.createDataFrame([("p", "s", "r", "full"), ("q", "s", "r", "full")], "paper_id string, source_sha256 string, run_signature string, task string")
    files = [("p", "b.json", "2"), ("p", "a.json", "1")]
    one, two = (budget.markers(runs, spark.createDataFrame(f, "paper_id string, name string, sha256 string")).collect() for f in (files, files[::-1]))
    assert one == two and [r["paper_id"] for r in one] == ["p"]
    used = spark.createDataFrame([("a", "x", 3), ("a", "x", 4), ("a", "y", 0), ("b", "x", 0)], "run_id string, stage string, tokens long")
    guess = spark.createDataFrame([("a", "x", 100), ("b", "x", 50), ("c", "z", 7)], used.schema)
    assert {tuple(r) for r in budget.spent(used, guess).collect()} == {("a", "x", 7, True), ("b", "x", 50, False), ("c", "z", 7, False)}
    m = spark.createDataFrame([("p", "t", 1.0), ("p", "u", 3.0), ("p", "t", 2.0), ("q", "t", 9.0), (None, "t", 1.0)], "paper_id string, task string, created_at double")
    assert [r["created_at"] for r in memory.entries(m, "p").collect()] == [3.0, 2.0, 1.0] and [r["created_at"] for r in memory.entries(m, "p", "t").collect()] == [2.0, 1.0]
    c = spark.createDataFrame([(f"c{i % 60:02d}",) for i in range(120)] + [(None,)], "concept string")
    assert [r[0] for r in memory.known_concepts(c).collect()] == [f"c{i:02d}" for i in range(40)]
