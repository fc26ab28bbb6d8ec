"""Resampling, whitening and packing against plain loops, and the cases that tables may hold."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlake.llm import packing, queries, resample, whiten
from paperlake.llm.common import stored

tokenizers = pytest.importorskip("public_tokenizers")
from tests.llm.test_operators import ODD, SCHEMA  # noqa: E402

ENCODER = "word_bpe_49k.json"


# resampling


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resampled(rows, targets, buckets=10_000, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *features(t)) for i, t in rows]
    raw = Counter(bucket(f) for _, _, fs in found for f in fs)
    target = Counter(bucket(f) for t in targets for f in features(t)[1])
    s, t = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    out = []
    for i, n, fs in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


def test_resampling_equals_a_plain_loop(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain_resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()])
    got = queries.op11_resample(spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("ranges", [1, 5])
def test_resampling_odd_rows(spark, monkeypatch, ranges):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["aB", "çé", "x1", "日本", "z" * 70, "q" * 9000]) + rng.choice(["", ",", "\x00", "@", "\n"]) for _ in range(rng.randrange(15, 60))), None, None, None) for i in range(100, 300)]
    rows += [*ODD, *ODD[:2], *[(None, "", None, None, None)] * 50]
    monkeypatch.setattr(resample, "RANKED_ROWS", 1 << 20 if ranges == 1 else 3)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("rank"), F.lit("x").alias("ids"), F.lit("y").alias("_text"))
    target = spark.createDataFrame([("ab çé x1 with words",), (None,), ("",)], "text string")
    got = resample.resampled(docs, target, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == plain_resampled([(r[0], r[1]) for r in rows], ["ab çé x1 with words"], percent=50)


def test_resampling_empty_tables_and_selection(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(f"d{i}", "one two three " * (i + 7)) for i in range(40)], "doc_id string, text string")
    assert resample.resampled(none, some).collect() == []
    got = resample.resampled(some, none, percent=10)
    assert got.count() == 40 and sorted(r["rank"] for r in got.where("rank is not null").collect()) == [1, 2, 3, 4]
    assert resample.selected(some, some, percent=10).count() == 4


def test_blocks_hold_the_counts(spark):
    texts = ["a b a b", None, "", "A-b\tc", "x" * 300 + " y"]
    words, indptr, indices, counts = resample.csr(pa.array(texts), 97, 2)
    for i, t in enumerate(texts):
        n, fs = features(t)
        own = Counter(zlib.crc32(f.encode()) % 97 for f in fs if f.count(" ") < 2)
        assert words[i] == n and dict(zip(indices[indptr[i] : indptr[i + 1]].tolist(), counts[indptr[i] : indptr[i + 1]].tolist())) == own
    assert [len(x) for x in resample.csr(pa.array([], pa.string()))] == [0, 1, 0, 0]


# whitening


def exact(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return x, fit, n, sums, cov


@pytest.mark.parametrize("scale", [1, 1e4, 5e14])
def test_whitening_is_exact(spark, scale):
    rng = np.random.default_rng(4)
    data = ((rng.standard_normal((60, 9)) * [1, 2, 3, 4, 5, 6, 7, 8, 9] + 5) * scale).astype(np.float32)
    vectors = data.tolist() + data[:20].tolist()
    bad = [(900, None), (901, [None, *vectors[0][1:]]), (902, [float("nan"), *vectors[0][1:]]), (903, [float("inf"), *vectors[0][1:]]), (904, []), (905, [1.0, 2.0]), (None, vectors[3])]
    df = spark.createDataFrame([*enumerate(vectors), *bad], "vec_id long, embedding array<float>").select("*", F.lit(1).alias("x"), F.lit(2).alias("v"), F.lit(3).alias("component"))
    x, fit, n, sums, cov = exact(vectors)
    model = whiten.fit(stored(whiten.quantized(df).select("x").distinct(), "x"))
    assert model.n == n and model.sums == sums and model.covariance.tolist() == [[float(c) for c in row] for row in cov]
    got = whiten.whitened(df, most=5).collect()
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == list(range(80)) and len(got) == 81 * 5
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in cov]))[::-1]
    for r in got:
        if r["vec_id"] is None:
            continue
        own = x[r["vec_id"]]
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        assert r["deviation"] == (deviation if deviation < 10**38 else None) and r["n"] == n
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
    w = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    first = {v: x.index(list(v)) for v in fit}
    table = np.array([[w[first[v], k] for k in range(1, 6)] for v in fit])
    assert np.abs(table.T @ table / n - np.eye(5)).max() < 1e-9
    # the components are eigenvectors: whitened values are uncorrelated and follow x alone
    assert all(w[i, 1] == w[first[tuple(x[i])], 1] for i in range(80))


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whitened(spark.createDataFrame([], schema)).collect() == []
    one = whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r["whitened"] == r["explained"] == r["identity_error"] == r["deviation"] == 0 for r in one)
    line = whiten.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], schema)).collect()
    by = {k: [r["whitened"] for r in line if r["component"] == k] for k in (1, 2, 3)}
    assert len(line) == 30 and abs(np.var(by[1]) - 1) < 1e-9 and set(by[2]) == set(by[3]) == {0.0}
    assert {r["identity_error"] < 1e-9 for r in line} == {True}


def test_limb_products_are_exact():
    rng = random.Random(2)
    x = np.array([[rng.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(9000)])
    got = sum((v.astype(object) << at) for at, v in whiten.gram(x).items())
    big = x.astype(object)
    assert (got == big.T @ big).all()
    back = sum(d.astype(object) << (32 * k) for k, d in enumerate(whiten.digits(got, 6)))
    assert (back == got).all()


def test_whitening_query(spark, sf_dir):
    got = queries.op12_whiten(spark, sf_dir)
    rows = got.collect()
    assert dict(got.dtypes)["deviation"] == "bigint" and len(rows) == 16 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


# packing


def least(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_search_keeps_bins_whole_and_saves_bins():
    rng, saved, apart = random.Random(8), 0, 0
    for _ in range(150):
        sizes = np.array([rng.randrange(1, 61) for _ in range(rng.randrange(1, 11))])
        bound, fewest = packing.least_bins(sizes, 100), least(sizes.tolist(), 100)
        one_each = packing.search(sizes, np.arange(len(sizes)), 100)
        for own in (packing.search(sizes, None, 100), one_each):
            fill = np.bincount(own, sizes)
            assert fill.max() <= 100 and fill.min() > 0 and bound <= fewest <= len(fill)
        # the search alone, from one bin for each, comes near the fewest
        apart += len(np.bincount(one_each)) - fewest
        saved += len(np.bincount(packing.best_fit(sizes, 100))) - len(np.bincount(packing.search(sizes, None, 100)))
    assert apart <= 12 and saved >= 0


def test_search_raises_the_sum_of_squares_by_each_kind_of_exchange():
    move, swap, two = ([60, 30, 10], [0, 1, 2], [100]), ([60, 40, 30], [0, 1, 1], [100, 30]), ([70, 20, 15, 14, 40], [0, 0, 1, 1, 1], [99, 60])
    for sizes, bins, fills in (move, swap, two):
        sizes, bins = np.array(sizes), np.array(bins)
        search = packing.Search(sizes, bins.copy(), 100)
        search.left = len(sizes)  # as if all bins could be saved
        after = np.bincount(search.run(), sizes)
        assert sorted(after[after > 0].tolist(), reverse=True) == fills and (after**2).sum() > (np.bincount(bins, sizes) ** 2).sum()


def plain_pieces(rows, length=4096):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(tokenizers.path(ENCODER)), []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            out.append((i, k // length, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return Counter(out)


def holds(rows, length):
    """Sequences are gapless from 0 and no longer than they may be."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= length
    return len(by)


def test_packing_query(spark, sf_dir):
    rows = queries.op13_pack(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == plain_pieces([(d["doc_id"], d["text"]) for d in docs])
    assert holds(rows, 4096) <= packing.least_bins(np.array([r["length"] for r in rows]), 4096) + 1


def test_packing_odd_rows(spark):
    rows = [*ODD, *[(None, "", None, None, None)] * 100]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("sequence_id"), F.lit("a").alias("offset"), F.lit("b").alias("length"), F.lit(2).alias("at"))
    found = packing.pieces(docs, tokenizers.path(ENCODER), length=512, with_ids=True)
    placed = packing.packed(found, length=512)
    got = placed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_pieces([(r[0], r[1]) for r in rows], 512)
    n = holds(got, 512)
    assert n == -(-sum(r["length"] for r in got) // 512)
    whole = packing.sequences(found, placed).collect()
    assert len(whole) == n and sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got)
    none = packing.pieces(spark.createDataFrame([], "doc_id string, text string"), tokenizers.path(ENCODER))
    assert packing.packed(none).collect() == []


def test_groups_go_on_together(spark):
    rng = random.Random(6)
    rows = [(i, min(4096, int(rng.lognormvariate(6, 1.2)) + 1)) for i in range(4000)]
    found = stored(spark.createDataFrame(rows, "at long, length long"), "lengths")
    got = packing.packed(found, group_rows=250).collect()
    assert sorted((r["at"], r["length"]) for r in got) == rows
    assert holds(got, 4096) <= -(-sum(n for _, n in rows) // 4096) + 1
    # where no two fit together nothing can be saved, and the rounds end
    large = stored(spark.createDataFrame([(i, 2049 + i % 2000) for i in range(600)], "at long, length long"), "lengths")
    assert holds(packing.packed(large, group_rows=100).collect(), 4096) == 600
