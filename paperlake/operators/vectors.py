"""Vectors: exact cosine search over lists around centroids, incremental embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.operators.common import kept, micro, small, top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for null or empty vectors, other lengths, and vectors without a norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm))


#: Vectors that centroids are fitted on, most lists, and vectors of a list that meet in a task.
SAMPLE, LISTS, PART = 16_384, 1024, 1 << 16
#: Scores are ranked in millionths; bounds give way by more than their rounding.
SLACK = 4e-6


@dataclass
class VectorIndex:
    """``rows`` (key, dim, list, part, r: the angle to the list's centroid, v: the unit vector)
    in the shared folder; of each dimension the centroids, and of each of its lists the number
    of vectors, the least and the largest angle."""

    key: str
    rows: DataFrame
    centroids: dict[int, np.ndarray]
    lists: dict[int, np.ndarray]


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length; those that are null, empty, without
    a norm or hold what is no number are left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        # a null entry is no number
        x = np.asarray(pc.fill_null(column.take(pa.array(at)).flatten().cast(pa.float64()), math.nan)).reshape(-1, d)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        yield at[good], x[good] / norm[good, None]


def _listed(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))


def _centroids(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], c)
    return c


def index(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
    """Lists of vectors around centroids. These are fitted on the ``sample`` rows of the smallest
    hashes of their keys, a bounded number; every vector is put into the list of the nearest
    one. Vectors of a dimension that the sample lacks are a list of their own. Rows without a
    unit vector are left out, as no cosine is theirs."""
    n = vectors.count()
    got = vectors.select(F.xxhash64(key).alias("h"), F.col(vec).alias("v")).orderBy("h").limit(sample).toArrow()
    centers: dict[int, np.ndarray] = {}
    if got.num_rows:
        for _, u in _units(got["v"].combine_chunks()):
            if len(u):
                centers[u.shape[1]] = _centroids(u, max(1, min(len(u), LISTS, math.isqrt(n))))
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    kind = vectors.schema[key].dataType

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at, u in _units(batch.column(1)):
                if not len(at):
                    continue
                c = shared.value.get(u.shape[1])
                cos = u @ c.T if c is not None else np.ones((len(u), 1))
                of = cos.argmax(axis=1)
                r = np.arccos(np.clip(cos[np.arange(len(u)), of], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(u), u.shape[1], np.int32)), pa.array(of.astype(np.int32)), pa.array(r), _listed(u)], ["key", "dim", "list", "r", "v"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("dim", T.IntegerType()), T.StructField("list", T.IntegerType()), T.StructField("r", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    rows = kept(vectors.select(key, vec).mapInArrow(place, schema), "vectors")
    lists: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dim", "list").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect():  # LISTS a dimension at most
        d = r["dim"]
        if d not in centers:
            centers[d], r = np.zeros((1, d)), {"list": 0, "n": r["n"], "low": 0.0, "high": math.pi}
        lists.setdefault(d, np.tile([0.0, math.pi, 0.0], (len(centers[d]), 1)))[r["list"]] = r["n"], r["low"], r["high"]
    return VectorIndex(key, rows, centers, lists)


def _cells(at: VectorIndex, cores: int) -> dict[int, np.ndarray]:
    """Of each dimension, for each list: its first cell and its number of cells. Vectors meet
    queries by cells, which hold lists of about ``n / 4 cores`` vectors together, or a part of
    one that has over ``PART``."""
    out, cell = {}, 0
    for d, x in at.lists.items():
        held, out[d], size = x[:, 0].astype(np.int64), np.zeros((len(x), 2), np.int64), 0
        most = min(PART, max(2048, int(held.sum()) // (4 * cores)))
        for i, n in enumerate(held.tolist()):
            parts = max(1, -(-n // PART))
            if size and size + n > most:
                cell, size = cell + 1, 0
            out[d][i] = cell, parts
            size += n
            if parts > 1:
                cell, size = cell + parts, 0
        cell += 1
    return out


def _probed(queries: DataFrame, at: VectorIndex, query: str, k: int | None, cells: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query, least, cell, u): the cells that each query looks into, or without ``cells`` (query,
    least, list, u): the lists. These are the nearest lists that hold ``k`` vectors together, or without ``k`` those that may hold one of a
    cosine of ``least``. By the triangle inequality a vector at angle r of a centroid is at an
    angle of |a - r| at least from a query at angle a."""
    place = "list" if cells is None else "cell"
    cells = cells or {d: np.stack([np.arange(len(x)), np.ones(len(x), np.int64)], axis=1) for d, x in at.lists.items()}
    shared = queries.sparkSession.sparkContext.broadcast((at.centroids, at.lists, cells))

    def probe(batches: Iterator[pa.RecordBatch]):
        centroids, lists, cells = shared.value
        for batch in batches:
            least = np.asarray(pc.fill_null(batch.column(2), -2.0))
            for rows, u in _units(batch.column(1)):
                if u.shape[1] not in lists:
                    continue
                held, low, high = lists[u.shape[1]].T
                first, parts = cells[u.shape[1]].T
                a = np.arccos(np.clip(u @ centroids[u.shape[1]].T, -1, 1))
                nearest = np.maximum(0, np.maximum(a - high, low - a))
                for row, angle, own, v in zip(rows.tolist(), a, nearest, u):
                    if k is None:
                        lists_of = np.flatnonzero((held > 0) & (np.cos(own) >= least[row] - SLACK))
                    else:
                        order = np.argsort(own + 1e-9 * angle, kind="stable")
                        order = order[held[order] > 0]
                        lists_of = order[: 1 + int(np.searchsorted(np.cumsum(held[order]), k))]
                    n = parts[lists_of]
                    c = np.unique(np.repeat(first[lists_of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    if len(c):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(c), row))), pa.array(np.full(len(c), least[row])), pa.array(c.astype(np.int32)), _listed(np.tile(v, (len(c), 1)))], [query, "least", place, "u"])

    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField("least", T.DoubleType()), T.StructField(place, T.IntegerType()), T.StructField("u", T.ArrayType(T.DoubleType()))])
    return queries.select(query, "query_vec", "least").mapInArrow(probe, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _best(rows: pa.Table, asked: pa.Table, key: str, query: str, k: int, other: bool) -> pa.Table:
    """(query, key, score_micro) of a cell's k best vectors for each query that looks into it.
    Blocks are multiplied as matrices; what can be among the best is summed in the order of
    the dimensions, as ``dot`` does, and ranked by millionths, then keys."""
    rows = rows.sort_by(key)
    keys, ids = rows[key].combine_chunks(), asked[query].combine_chunks()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(keys) and len(ids):
        v, u, least = _matrix(rows["v"]), _matrix(asked["u"]), np.asarray(asked["least"])
        size = max(1, (1 << 22) // len(v))
        for b in range(0, len(u), size):
            s = u[b : b + size] @ v.T
            low = least[b : b + size].copy()
            full = np.flatnonzero((s >= low[:, None] - SLACK).sum(axis=1) > 4 * k + 4)
            if len(full) and len(v) > k:
                low[full] = np.maximum(low[full], np.partition(s[full], len(v) - k - 1, axis=1)[:, len(v) - k - 1])
            i, j = np.nonzero(s >= low[:, None] - SLACK)
            i += b
            if other:
                same = pc.equal(keys.take(pa.array(j)), ids.take(pa.array(i)))
                apart = ~np.asarray(pc.fill_null(same, True))
                i, j = i[apart], j[apart]
            x = np.zeros(len(i))
            for d in range(v.shape[1]):
                x += u[i, d] * v[j, d]
            m = np.floor(x * 1e6 + 0.5).astype(np.int64)
            order = np.lexsort((j, -m, i))
            i, j, m = i[order], j[order], m[order]
            stays = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[stays], j[stays], m[stays]))
    i, j, m = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    return pa.table({query: ids.take(pa.array(i)), key: keys.take(pa.array(j)), "score_micro": pa.array(m)})


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", query: str = "query_id", vec: str = "embedding", other: bool = True, at: VectorIndex | None = None) -> DataFrame:
    """(query, rank, key, score_micro) of the k vectors of the highest cosine to each query
    vector, exactly. The nearest lists give the k-th best so far; lists that can't reach it are
    left out. Vectors and queries meet by cells of lists, as matrices, and of each cell only its
    k best leave it. A list of many vectors is cut by the hash of their keys, the queries of a
    cell by that of theirs. ``other``: a vector is no answer to a query of its own id. Queries
    have different ids. ``at``: the vectors' index, if there is one."""
    at = at or index(vectors, key, vec)
    cells = _cells(at, vectors.sparkSession.sparkContext.defaultParallelism)
    of = [(d, i, int(c), int(n)) for d, x in cells.items() for i, (c, n) in enumerate(x.tolist())]
    if not of:
        of = [(0, 0, 0, 1)]
    where = F.broadcast(vectors.sparkSession.createDataFrame(of, "dim int, list int, _first int, _parts int"))  # LISTS a dimension at most
    rows = at.rows.join(where, ["dim", "list"]).select((F.col("_first") + F.pmod(F.xxhash64(key), F.col("_parts"))).cast("int").alias("cell"), key, "v")
    shares = max(1, -(-queries.count() // PART))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    kind = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, at.rows.schema[key].dataType), T.StructField("score_micro", T.LongType())])

    def scored(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("share", F.pmod(F.xxhash64(query), F.lit(shares)).cast("int"))
        met = rows.groupBy("cell", "share").cogroup(asked.groupBy("cell", "share")).applyInArrow(lambda a, b: _best(a, b, key, query, k, other), kind)
        return top(met, [query], [F.desc("score_micro"), F.asc(key)], k)

    first = _probed(queries.withColumn("least", F.lit(-2.0)), at, query, 2 * k + 1, cells)
    found = scored(first)
    least = found.where(F.col("rank") == k).select(query, (F.col("score_micro") / 1e6).alias("least"))
    bounded = queries.select(query, "query_vec").join(small(kept(least, "least")), query, "left")
    return scored(_probed(bounded, at, query, None, cells)).select(query, "rank", key, "score_micro")


def to_embed(notes: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """Retrievable notes of which the text has no vector of ``model`` yet: (id, content, hash).
    ``known``: (owner_id, model, hash)."""
    from paperlake.functions.text import content_hash
    from paperlake.operators.memory import retrievable

    rows = notes.where(retrievable() & (F.col("kind") != "entity")).select("id", "content", content_hash(F.col("content")).alias("hash"))
    have = known.where(F.col("model") == model).select(F.col("owner_id").alias("id"), "hash")
    return rows.join(have, ["id", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (owner_type, owner_id, model, dim, hash, vec): new rows replace old ones of the
    same owner and model. Other dimensions of one model are an error."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    kept = top(both, ["owner_type", "owner_id", "model"], [F.asc("_age"), F.asc("hash")], 1).drop("_age", "rank")
    sizes = kept.groupBy("model").agg(F.countDistinct("dim").alias("_dims"))
    return kept.join(small(sizes), "model").where(F.when(F.col("_dims") > 1, F.raise_error(F.lit("mixed dimensions"))).otherwise(F.lit(True)).cast("boolean")).drop("_dims")


def deleted(vectors: DataFrame, dead: DataFrame, model: str | None = None) -> DataFrame:
    """``vectors`` without those of the owners in ``dead`` (owner_id); of one model, if given."""
    ids = dead.select("owner_id").distinct()
    if model is None:
        return vectors.join(ids, "owner_id", "left_anti")
    mine = F.coalesce(F.col("model") == model, F.lit(False))
    return vectors.where(~mine).unionByName(vectors.where(mine).join(ids, "owner_id", "left_anti"))


def counts(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(model, dim, vectors) to hold against what should be there; null vectors have dim 0."""
    dim = F.coalesce(F.size(F.col(vec)), F.lit(0))
    return vectors.groupBy("model", F.when(dim < 0, 0).otherwise(dim).alias("dim")).agg(F.count("*").alias("vectors"))
