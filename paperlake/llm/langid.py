"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a blank, and its n-grams of ``ORDERS``
are hashed into ``BINS`` bins each. Fitting counts bins by language on the executors and sums
them in Spark, so at most languages x bins rows reach the driver. Scoring adds the rows of
the broadcast log-probability matrix for all n-grams of a batch of texts at once.

Null texts, and texts without a letter, are ``und`` with score 0; so is everything if no
labelled row was given. Ties go to the first language in alphabetical order. Repeated rows
count as often as they occur in fitting and have the same result in scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import give_back, named_apart, slices

ORDERS, BINS = (1, 2, 3), 1 << 14
SHARPNESS = 40.0
SLICE_BYTES = 1 << 20
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point -> itself if a letter, else a blank; one per Python worker."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32))
    return _letters[0]


def has_letter(text: str | None) -> bool:
    """Digits, fractions, numerals and marks are no letters."""
    return any(map(str.isalpha, text or ""))


def bins_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams, a row for each order, and where each text begins in the columns.
    What runs over a text's end has the bin after the last. Texts must not be empty."""
    points = np.frombuffer("\0".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 0)
    if len(ends) != len(texts):  # texts with NUL characters of their own
        return bins_of([t.replace("\0", " ") for t in texts])
    starts = np.concatenate([[0], ends[:-1] + 1])
    chars = _table()[points]
    out, gram = np.empty((len(ORDERS), len(points)), np.int32), np.zeros(len(points), np.uint32)
    for row, order in enumerate(range(1, max(ORDERS) + 1)):
        k = order - 1
        gram = gram * np.uint32(0x01000193)
        gram[: len(gram) - k] ^= chars[k:]
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1)
        bins = (mixed >> np.uint32(32 - int(np.log2(BINS)))).astype(np.int32) + row * BINS
        over = (ends[:, None] - np.arange(order)).ravel()
        bins[over[over >= 0]] = len(ORDERS) * BINS
        out[row] = bins
    return out, starts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (orders x bins + 1, languages), log-probabilities, the last row zero

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if rows and self.languages:
            bins, starts = bins_of([texts[i] for i in rows])
            total = sum(np.add.reduceat(self.weights[b], starts, axis=0, dtype=np.float64) for b in bins)
            lengths = np.diff(np.append(starts, bins.shape[1]))
            logits = total / lengths[:, None] * np.minimum(lengths, SHARPNESS)[:, None]
            logits -= logits.max(axis=1, keepdims=True)
            likely = np.exp(logits)
            likely /= likely.sum(axis=1, keepdims=True)
            best = logits.argmax(axis=1)
            scores[rows] = likely[np.arange(len(rows)), best]
            for i, k in zip(rows, best.tolist()):
                names[i] = self.languages[k]
        return names, scores


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str | Column = "doc_id", rows_per_language: int | None = 3000, smoothing: float = 0.5) -> Model:
    """Learns from ``labelled``: rows of which text or language is null are left out. Of each
    language about ``rows_per_language`` rows count, taken by a hash of ``key`` (all: None);
    that bound is for speed alone, as nothing but counts leaves the executors. The model has
    ``BINS`` numbers for each order and language; all the languages there are count."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h")).where("text is not null and lang is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(found)
    if not names:
        return Model([], np.zeros((1, 0), np.float32))
    if rows_per_language is not None:
        share = {n: min(1.0, rows_per_language / found[n]) for n in names}
        taken = F.lit(False)
        for n in names:
            taken = taken | ((F.col("lang") == n) & (F.pmod("h", F.lit(1 << 30)) < int(share[n] * (1 << 30))))
        rows = rows.where(taken)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, 0, SLICE_BYTES):
                texts, langs = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                for name in set(langs):
                    own = [t for t, n in zip(texts, langs) if n == name and has_letter(t)]
                    if own:
                        add = np.bincount(bins_of(own)[0].ravel(), minlength=len(ORDERS) * BINS + 1)[:-1]
                        sums[name] = sums[name] + add if name in sums else add
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bin", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(ORDERS), BINS, len(names)))
    got = counted.toArrow()
    at = {n: i for i, n in enumerate(names)}
    column = np.array([at[n] for n in got["lang"].to_pylist()], np.int64)
    counts.reshape(-1, len(names))[got["bin"].to_numpy(), column] = got["n"].to_numpy()
    counts += smoothing
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(-1, len(names))
    return Model(names, np.vstack([logs, np.zeros((1, len(names)))]).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score as ``names``; columns of these names are replaced."""
    docs = docs.drop(*names)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at, SLICE_BYTES):
                found, scores = shared.value.score(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.string()), pa.array(scores)], [*piece.schema.names, *names])
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a learned language with a score of ``least`` or more. If no
    language was learned nothing can be told, and all rows stay. Columns may have any names."""
    if not model.languages:
        return docs
    own = tuple(named_apart(docs, "_lang_pred", "_lang_score"))
    return predict(docs, model, text, own).where((F.col(own[0]) != "und") & (F.col(own[1]) >= least)).drop(*own)
