"""The folder source, table functions, timers and counters."""

import json
import os
import time

from pyspark.sql import functions as F

from paperlake import plans
from paperlake.operators import extraction, graph
from paperlake.sources.folder import PaperFolder
from paperlake.streaming import ingest


def _put(folder, name, data, at):
    path = folder / name
    path.write_bytes(data)
    os.utime(path, (at, at))


def test_folder_source(spark, tmp_path):
    spark.dataSource.register(PaperFolder)
    now = time.time() - 1000
    _put(tmp_path, "a b.txt", b"text \xff of a paper", now)
    _put(tmp_path, "good.json", json.dumps({"x": [1, 2]}).encode(), now + 1)
    _put(tmp_path, "broken.json", b'{"x": [1, 2, ', now + 2)
    _put(tmp_path, "small.md", b"x", now + 3)
    _put(tmp_path, "scan.pdf", b"%PDF-1.4 something", now + 4)
    _put(tmp_path, "other.exe", b"something else here", now + 4)
    (tmp_path / "deep").mkdir()
    _put(tmp_path / "deep", "more.md", b"# Title of more", now + 5)
    rows = spark.read.format("paper_folder").load(f"file://{tmp_path}")
    got = {r["paper_id"]: (r["suffix"], r["content"], r["problem"]) for r in rows.collect()}
    assert got == {"a_b": ("txt", "text � of a paper", None), "good": ("json", '{"x": [1, 2]}', None), "broken": ("json", '{"x": [1, 2, ', "json"), "small": ("md", None, "size"), "scan": ("pdf", None, None), "other": ("exe", None, "suffix"), "more": ("md", "# Title of more", None)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("paper_folder").option("pushdown", "true").load(f"file://{tmp_path}").where("suffix = 'json' and problem is null")
        assert [r["paper_id"] for r in some.collect()] == ["good"]
        assert [r["paper_id"] for r in spark.read.format("paper_folder").option("pushdown", "true").load(f"file://{tmp_path}").where("paper_id in ('more', 'scan') and suffix = 'md'").collect()] == ["more"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("paper_folder").load(f"file://{tmp_path}/none").count() == 0


def test_folder_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(PaperFolder)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    now = time.time() - 1000

    def drain():
        stream = spark.readStream.format("paper_folder").option("path", f"file://{folder}").option("maxFilesPerTrigger", 2).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["paper_id"] for r in spark.read.parquet(out).collect())

    for i in range(5):
        _put(folder, f"p{i}.txt", b"text of a paper", now + i)
    assert drain() == ["p0", "p1", "p2", "p3", "p4"]
    assert drain() == ["p0", "p1", "p2", "p3", "p4"]
    _put(folder, "p9.txt", b"text of a paper", now + 50)
    _put(folder, "p1.txt", b"another text of it", now + 60)
    assert drain() == ["p0", "p1", "p1", "p2", "p3", "p4", "p9"]


def test_rested_keys_equal_the_batch(spark, sf_dir, tmp_path):
    """Timers over the events as a stream of several files give the users of the cool-down query."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
        events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
        stream = ingest.files(spark, str(tmp_path / "in"), events.schema, per_trigger=3)
        out = str(tmp_path / "out")
        ingest.drain(ingest.rested(stream, "user_id", "ts"), str(tmp_path / "state"), ingest.idempotent_sink(out))
        got = [r["user_id"] for r in spark.read.parquet(out).collect()]
        want = [r["user_id"] for r in plans.QUERIES["review_cooldown"](spark, sf_dir).collect()]
        assert sorted(got) == sorted(want)
    finally:
        spark.conf.unset(key)


def test_every_third_paper(spark, tmp_path):
    seen = []
    finish = ingest.every_new(str(tmp_path / "papers"), 3, lambda papers: seen.append(papers.count()))
    batch = lambda ids: spark.createDataFrame([(i,) for i in ids], "paper_id string")
    finish(batch(["a", "b"]), 0)
    finish(batch(["c", "d"]), 1)
    finish(batch(["c", "d"]), 1)  # comes again
    finish(batch(["e"]), 2)
    finish(batch(["f", "g", "h", "i"]), 3)
    assert seen == [4, 4, 9]


def test_answers_are_taken_as_a_whole(spark):
    good = {"entities": [{"name": " A ", "type": "Algorithm/Model"}, {"name": "B", "type": "Problem/Task"}], "relations": [{"from": "A", "rel": "Requires", "to": "B"}]}
    bad = [None, [], {"entities": [], "relations": []}, {"entities": "x", "relations": []}, {**good, "entities": [*good["entities"], {"name": "", "type": "Problem/Task"}]}, {**good, "entities": [*good["entities"], "x"]}, {**good, "relations": [{"from": "A", "rel": "Cites", "to": "B"}]}, {**good, "relations": [{"from": "A", "rel": "Requires", "to": "C"}]}, {**good, "relations": [7]}]
    answers = {"good": [good], "late": [bad[4], good], **{f"bad{i}": [b, b] for i, b in enumerate(bad)}}

    def extractor(text, attempt):
        if text.startswith("fails"):
            raise RuntimeError("no answer")
        return answers[text.split("\n")[0]][attempt]

    rows = [(k, 1, k) for k in answers] + [("good", 2, "more"), ("fails", 1, "fails"), (None, 1, "good")]
    df = spark.createDataFrame(rows, "paper_id string, ord int, text string")
    got = extraction.extracted(df, extractor).collect()
    status = {r["paper_id"]: r["status"] for r in got}
    assert status == {None: "ACCEPTED", "good": "ACCEPTED", "late": "RETRY_ACCEPTED", "fails": "MANUAL_REVIEW", **{f"bad{i}": "MANUAL_REVIEW" for i in range(len(bad))}}
    assert sorted((r["kind"], r["name"], r["src"], r["dst"]) for r in got if r["paper_id"] == "late" and r["kind"] == "entity") == [("entity", "A", None, None), ("entity", "B", None, None)]
    assert [(r["src"], r["rel"], r["dst"]) for r in got if r["paper_id"] == "good" and r["kind"] == "relation"] == [("A", "Requires", "B")]
    assert all(r["reason"] for r in got if r["status"] == "MANUAL_REVIEW")


def test_newest_before(spark):
    ids = [3, 5, 6, 9, 20, 21, 40]
    notes = spark.createDataFrame([(i,) for i in [*ids, 9]], "other long")
    asking = spark.createDataFrame([(i,) for i in (3, 9, 40)], "id long")
    got = {tuple(r) for r in graph.newest_before(asking, notes, 3).collect()}
    assert got == {(9, 3), (9, 5), (9, 6), (40, 9), (40, 20), (40, 21)}


def test_workers_get_the_package(tmp_path):
    """A driver elsewhere, with the package on its own path alone."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from paperlake.session import session
from paperlake.operators import vectors
spark = session("t", **{{"spark__master": "local[2]", "spark__ui__enabled": "false", "spark__checkpoint__dir": "file://{tmp_path}/shared"}})
rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
asked = rows.selectExpr("vec_id AS query_id", "embedding AS query_vec").where("query_id = 1")
print("FOUND", [r["vec_id"] for r in vectors.topk(rows, asked, 1).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "FOUND [2]" in out.stdout, out.stderr[-2000:]


def test_links_of_any_split_equal_the_batch(spark, tmp_path):
    """One file a micro-batch, in two splits; those that meet no keyword have no link."""
    import random

    from paperlake.streaming import linking

    rng = random.Random(4)
    words = [f"w{i}" for i in range(14)] + [f"keyword{i}" for i in range(3)]
    notes = [(i, rng.sample(words, rng.randrange(0, 8)) if i % 9 else []) for i in range(150)] + [(200 + i, ["Same"]) for i in range(40)]
    df = spark.createDataFrame(notes, "id long, keywords array<string>")
    # the plain rule
    low = {i: [w.lower() for w in k] for i, k in notes}
    want, back = set(), {}
    for i in sorted(low):
        mine, near = set(low[i]), set()
        for w in dict.fromkeys(low[i][:6]):
            near |= set([o for o in sorted(low) if o < i and w in low[o]][:12])
        good = [o for o in sorted(near)[:12] if any(len(w) >= 5 for w in mine & set(low[o])) or len(mine & set(low[o])) >= 2 or len(mine & set(low[o])) / len(mine | set(low[o])) >= 0.28]
        for o in good[:6]:
            back[o] = back.get(o, 0) + 1
            if back[o] <= 24:
                want.add((i, o))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, cuts in (("a", [0, 60, 61, 190]), ("b", [0, 190])):
            folder, links = tmp_path / name, tmp_path / f"{name}-links"
            for at, (low_, high) in enumerate(zip(cuts, cuts[1:])):
                df.where(F.col("id").isin([n[0] for n in notes[low_:high]])).coalesce(1).write.parquet(str(folder / f"in/part={at}"))
            schema = df.schema
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/part=*"))
            ingest.drain(linking.offers(stream), str(tmp_path / f"{name}-state"), lambda b, n, links=links: linking.chosen(b).coalesce(1).write.mode("overwrite").parquet(f"{links}/batch={n}"))
            taken = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{links}/batch=*")
            out = str(tmp_path / f"{name}-out")
            ingest.drain(linking.rooms(taken), str(tmp_path / f"{name}-rooms"), ingest.idempotent_sink(out))
            got = [tuple(r) for r in spark.read.parquet(out).select("src", "dst").collect()]
            assert len(got) == len(set(got))
            assert {s for s, _ in got} == {s for s, _ in want}
            assert len(got) == len(want) and set(got) == want, (name, len(got), len(want))
    finally:
        spark.conf.unset(key)
