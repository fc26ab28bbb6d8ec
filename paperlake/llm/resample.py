"""Importance resampling: draws the documents that look most like a target distribution.

Features of a text are its runs of one to three consecutive words; each is hashed to one of
``buckets`` columns by the CRC-32 of its bytes. The sparse matrix of documents by buckets is
written to the shared folder as CSR blocks (``count_matrix``), so texts are read once. Column
sums of the blocks give the raw distribution, those of the target's blocks the target's;
their smoothed log ratio is a whole-number gain for each bucket, and the product of the matrix
with the gains gives each document's weight. Gumbel noise from the document's id turns the
highest weights into a draw without replacement (``drawn``).

Only ``buckets`` numbers ever reach the driver. A block has about ``ENTRIES`` entries; a very
long text is a row of ``buckets`` entries at most. Documents with equal text are rows like any other; nothing is grouped by document or by
word, so no key is hot. Null texts have no features, null ids draw the noise of the empty id,
and rows of one id and score are ranked by their block and place in it. A table without
documents gives no rows; a target without features gives gains for an empty target. Only
the two named columns are read, whatever others a table has.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import give_back, new_path, slices, stored
from paperlake.llm.tokenfile import spans

BUCKETS, RUN = 10_000, 3
#: Bytes of text that are counted at once; words shorter than ``SHORT`` have tables of their own.
SLICE_BYTES, SHORT = 2 << 20, 64
#: Entries of a block, and bytes of blocks that a reader takes at once, about.
ENTRIES, GROUP_BYTES = 1 << 15, 8 << 20
#: Rows that a task of the final ranking gets, about.
RANKED_ROWS = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: Bytes of words: digits, small letters and all of UTF-8 beyond ASCII.
_in_word = np.zeros(256, bool)
_in_word[48:58] = _in_word[97:123] = _in_word[128:] = True


class Shift:
    """CRC-32 of joined byte strings from those of the parts: crc(a + b) is crc(b) xor a linear
    function of crc(a) that depends on the length of b alone. Four tables of 256 entries hold
    that function for a length: one for each short length, and one for each power of two."""

    def __init__(self):
        self.short = np.stack([self._tables(n) for n in range(SHORT)])
        self.powers: list[np.ndarray] = []

    @staticmethod
    def _tables(n: int) -> np.ndarray:
        zeros = bytes(n)
        base = zlib.crc32(zeros)
        bits = np.array([zlib.crc32(zeros, 1 << b) ^ base for b in range(32)], np.uint32)
        out = np.zeros((4, 256), np.uint32)
        values = np.arange(256)
        for part in range(4):
            for b in range(8):
                out[part] ^= np.where(values >> b & 1, bits[8 * part + b], 0).astype(np.uint32)
        return out

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The crcs of (crc's string followed by ``lengths`` bytes), but for those bytes' own."""
        flat, low = self.short.reshape(SHORT * 4, 256), (lengths % SHORT).astype(np.int64) * 4
        out = flat[low, crc & 255] ^ flat[low + 1, crc >> 8 & 255] ^ flat[low + 2, crc >> 16 & 255] ^ flat[low + 3, crc >> 24]
        rest, k = lengths // SHORT, 0
        while rest.any():
            if k == len(self.powers):
                # twice as many bytes: the tables of the power before, applied to themselves
                last = self.powers[-1] if self.powers else self._tables(SHORT // 2)
                self.powers.append(self._apply(last, last))
            some = np.flatnonzero(rest & 1)
            out[some] = self._apply(self.powers[k], out[some])
            rest, k = rest >> 1, k + 1
        return out


_shift: list[Shift] = []


def shift() -> Shift:
    if not _shift:
        _shift.append(Shift())
    return _shift[0]


def csr(texts: pa.Array, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, indptr, indices, counts) of the texts' bucket counts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return tuple(np.zeros(n, np.int64) for n in (0, 1, 0, 0))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _lower[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)]
    offsets = offsets - offsets[0]
    inside = _in_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    lengths = np.flatnonzero(last) + 1 - starts
    words = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    doc = np.repeat(np.arange(len(texts)), words)
    # each different word is hashed once
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[inside]))]).dictionary_encode()
    own = np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    at = coded.indices.to_numpy()
    joined, combine = own[at], shift()
    found = [(doc, joined)]
    # a blank before the word: the blank's crc, moved over the word
    blank = np.full(len(joined), zlib.crc32(b" "), np.uint32)
    spaced = combine(blank, lengths) ^ joined
    for n in range(1, run):
        same = doc[n:] == doc[: len(doc) - n]
        joined = combine(joined[: max(0, len(doc) - n)], lengths[n:] + 1) ^ spaced[n:]
        found.append((doc[n:][same], joined[same]))
    keys = np.sort(np.concatenate([d * np.int64(buckets) + c % np.uint32(buckets) for d, c in found]))
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(np.append(new, len(keys)))
    of, indices = np.divmod(keys[new], buckets)
    return words, np.searchsorted(of, np.arange(len(texts) + 1)), indices, counts


def block_type(id_type: T.DataType) -> T.StructType:
    whole = T.ArrayType(T.IntegerType())
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(n, whole) for n in ("words", "lengths", "indices", "counts")]])


def count_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """The matrix of ``docs`` as CSR blocks of about ``ENTRIES`` entries, a row each, in the
    shared folder: block (a number that no other block has), ids, words (a text's number of
    words), lengths (entries of each row of the matrix, the steps of its row pointer), indices,
    counts. Rows of ``docs`` are rows of the matrix; texts are taken whole."""
    spark, rows = docs.sparkSession, docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = block_type(rows.schema["id"].dataType)

    def blocks(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                words, indptr, indices, counts = csr(piece.column(1), buckets, run)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(indptr[:-1] // ENTRIES)) + 1, [piece.num_rows]])
                whole = lambda x: pa.array(x.astype(np.int32))
                by_row = [pa.ListArray.from_arrays(whole(cuts), x) for x in (piece.column(0), whole(words), whole(np.diff(indptr)))]
                by_entry = [pa.ListArray.from_arrays(whole(indptr[cuts]), whole(x)) for x in (indices, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(cuts) - 1)), *by_row, *by_entry], schema.names)
                number += len(cuts) - 1
            give_back()

    path = new_path(spark, "csr")
    # readers take a row group at a time
    rows.mapInArrow(blocks, schema).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(schema).parquet(path)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: a task sums its blocks, then tasks' sums are added."""

    def sums(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            # no sum over a batch is near 2 ** 53
            total += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = matrix.select("indices", "counts").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln) of each bucket's smoothed share of the target over that of the raw
    data, in doubles; counts are smoothed by one."""
    n, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    ratio = [float(t + 1) * (all_raw + n) / (float(s + 1) * (all_target + n)) for t, s in zip(target.tolist(), raw.tolist())]
    return np.array([math.floor(scale * math.log(r)) for r in ratio], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, block, place): the product of the matrix with
    ``gain``, which is sent to the tasks (``buckets`` numbers). Without features: 0."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)
    id_type = matrix.schema["ids"].dataType.elementType
    names = ["doc_id", "n_words", "n_features", "weight", "block", "place"]

    def product(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            block, ids, words, lengths, indices, counts = (batch.column(i) for i in range(6))
            rows = np.asarray(ids.value_lengths())
            n = counts.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(), dtype=np.int64)])
            of_rows = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]))
            yield pa.RecordBatch.from_arrays([ids.flatten(), words.flatten().cast(pa.int64()), of_rows(n), of_rows(n * shared.value[indices.flatten().to_numpy()]), pa.array(np.repeat(block.to_numpy(), rows)), pa.array(spans(np.zeros(len(rows), np.int64), rows))], names)

    return matrix.mapInArrow(product, T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, T.LongType()) for n in names[1:]]]))


def noise(doc_id: str = "doc_id", seed: int = 42, scale: int = 1000):
    """Gumbel noise in whole numbers, from the first 8 hexadecimal digits of the SHA-256 of
    ``seed:id``; -scale * ln(-ln(u)) rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``scored`` (a stored table with doc_id, n_words, score, block, place) with ``rank``: 1,
    2, 3, ... for the floor(percent * N / 100) highest scores of the N rows with at least
    ``least_words`` words, equal ones by doc_id (nulls first), block and place; else null.

    A quantile, checked by a count, bounds the drawn scores from below. Only rows above it are
    shuffled: into ranges of scores, each ranked by its own, with the ranges' counts as offsets.
    """
    fits = F.col("n_words") >= least_words
    eligible = scored.where(fits)
    n = eligible.count()
    k = percent * n // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    ranges = max(1, -(-k // RANKED_ROWS))
    share = 1 - percent / 100
    for below in (0.001, 0.01, 0.1, 1.0):
        low = max(0.0, share - below)
        least, above = eligible.agg(F.percentile_approx("score", low, 10_000), F.min("score")).first()
        least = above if below == 1.0 else least
        if eligible.where(F.col("score") >= least).count() >= k:
            break
    near = fits & (F.col("score") >= least)
    cuts = scored.where(near).agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0]
    # the number of cuts above the score: 0 for the highest range
    spans_of = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c > F.col("score")))
    rows = scored.where(near).withColumn("_range", spans_of)
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # ``ranges`` rows
    before = np.concatenate([[0], np.cumsum([sizes.get(part, 0) for part in range(ranges)])]).tolist()
    offset = F.get(F.lit(before), F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "block", "place"))
    ranked = rows.withColumn("rank", place + offset).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("_range")
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, run: int = RUN, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank."""
    matrix = count_matrix(docs, doc_id, text, buckets, run)
    wanted = count_matrix(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), "_id", "_text", buckets, run)
    gain = gains(column_sums(wanted, buckets), column_sums(matrix, buckets))
    scored = stored(weights(matrix, gain).withColumn("score", F.col("weight") + noise(seed=seed)), "scored")
    return drawn(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def selected(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ``how`` as in ``resampled``. ``docs``
    must have different ids."""
    kept = resampled(docs, target, doc_id, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(doc_id))
    return docs.join(kept, doc_id, "left_semi")
