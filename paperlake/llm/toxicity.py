"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs between ASCII white space, lower-cased, with all but letters and digits
removed. A word enters by a hashed word vector and by the mean of its hashed character
trigram vectors. Windows of ``WINDOW`` words, one every ``STRIDE``, cover the whole text (the
last one is moved back to end with it); both directions of the network run over each window,
attention pools its states, and the document's logit is that of its highest window.

Only documents are labelled, so training has to find the windows that count: first those of
toxic documents that hold the words, or words with the runs of ``STEM`` characters, most
peculiar to such documents (around these, other words are drawn from clean windows), then, round by round,
the network's own highest windows of toxic documents against the highest and some random
windows of clean ones. A part of the sample is held back to place the score of 0.7.

A null or empty text, or one without a word, has the score of an empty window. Without rows
of both labels the model says 0 for all. Repeated rows count as often as they occur in the
sample and have equal scores.
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import give_back, named_apart, slices
from paperlake.llm.tokenfile import spans

WINDOW, STRIDE = 24, 16
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 14, 8, 8
STEM, STEMS = 5, 1 << 20
SLICE_BYTES = 4 << 20
CHUNK = 2048


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the words of all texts by number, and how many each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for blank in "\n\t\r\x0b\x0c":
        texts = pc.replace_substring(texts, blank, " ")
    parts = pc.split_pattern(texts, " ")
    coded = parts.values.dictionary_encode()
    clean = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]+", "").dictionary_encode()
    empty = pc.index(clean.dictionary, pa.scalar("", clean.dictionary.type)).as_py()
    index = clean.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int32)
    kept = index != empty
    ends = np.concatenate([[0], np.cumsum(kept)])[np.asarray(parts.offsets)]
    return clean.dictionary, index[kept].astype(np.int64), np.diff(ends)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of words and document of every window."""
    per = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), per)
    k = spans(np.zeros(len(counts), np.int64), per)
    size = np.minimum(counts, WINDOW)[doc]
    start = (np.cumsum(counts) - counts)[doc] + np.minimum(k * STRIDE, np.maximum(0, counts - WINDOW)[doc])
    return start, size, doc


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed id of each word; hashed ids of all words' trigrams, and how many each word has."""
    data = [w.encode() for w in words.to_pylist()]
    ids = np.fromiter((zlib.crc32(w) % WORDS for w in data), np.int64, len(data))
    points = np.frombuffer("".join(f"<{w}>" for w in words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.asarray(pc.utf8_length(words), np.int64) if len(words) else np.empty(0, np.int64)
    starts = np.cumsum(counts + 2) - counts - 2
    at = spans(starts, counts)
    mixed = (points[at] * np.uint32(0x01000193) ^ points[at + 1]) * np.uint32(0x01000193) ^ points[at + 2]
    return ids, (((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(np.log2(GRAMS)))).astype(np.int64), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = -50.0

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        p = {"word": draw(WORDS, DIM, s=0.1), "gram": draw(GRAMS, DIM, s=0.3), "v": draw(2 * HIDDEN, s=0.3), "w": draw(2 * HIDDEN, s=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"in_{d}": draw(2 * DIM, 3 * HIDDEN, s=0.4), f"at_{d}": draw(HIDDEN, 3 * HIDDEN, s=0.25), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(p)

    def vectors(self, words: pa.Array) -> np.ndarray:
        ids, tri, counts = grams(words)
        out = np.zeros((len(ids), 2 * DIM), np.float32)
        out[:, :DIM] = self.p["word"][ids]
        some = np.flatnonzero(counts > 0)
        if len(some):
            out[some, DIM:] = np.add.reduceat(self.p["gram"][tri], (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
        return out

    def logits(self, words: pa.Array, index: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A logit for each window; the projections of a word are made once."""
        x = np.vstack([self.vectors(words), np.zeros((1, 2 * DIM), np.float32)])
        two = 2 * HIDDEN
        gates, heads = {}, {}
        for d in "fb":
            g, u = x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"], self.p[f"at_{d}"]
            # update and reset gates enter exp() with their sign turned
            gates[d] = -g[:, :two], np.ascontiguousarray(g[:, two:])
            heads[d] = np.ascontiguousarray(-u[:, :two]), np.ascontiguousarray(u[:, two:])
        index = np.append(index, len(words))
        out = np.empty(len(start), np.float32)
        steps = np.arange(WINDOW)
        for low in range(0, len(start), CHUNK):
            n = size[low : low + CHUNK]
            inside = (steps < n[:, None]).T
            at = index[np.where(inside, start[low : low + CHUNK] + steps[:, None], len(index) - 1)]
            states = np.empty((WINDOW, len(n), two), np.float32)
            full = n.min() == WINDOW
            zr, new, q = np.empty((len(n), two), np.float32), np.empty((len(n), HIDDEN), np.float32), np.empty((len(n), HIDDEN), np.float32)
            for d, order in (("f", range(WINDOW)), ("b", reversed(range(WINDOW)))):
                h, (u_zr, u_n), (g_zr, g_n) = np.zeros((len(n), HIDDEN), np.float32), heads[d], gates[d]
                part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
                for t in order:
                    np.matmul(h, u_zr, out=zr)
                    zr += g_zr[at[t]]
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.matmul(h, u_n, out=q)
                    q *= zr[:, HIDDEN:]
                    q += g_n[at[t]]
                    np.tanh(q, out=new)
                    np.subtract(h, new, out=q)
                    q *= zr[:, :HIDDEN]
                    q += new
                    h = q.copy() if full else np.where(inside[t, :, None], q, h)
                    states[t, :, part] = h
            e = states @ self.p["v"]
            e[~inside] = -30.0
            e = np.exp(e - e.max(axis=0))
            value = states @ self.p["w"]
            out[low : low + CHUNK] = (e * value).sum(axis=0) / e.sum(axis=0) + self.p["b"]
        return out

    def gradients(self, words_in: tuple, at: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray, drop: np.random.Generator) -> dict[str, np.ndarray]:
        """Of the weighted mean of log losses over windows ``at`` (words by number)."""
        p, (ids, tri, counts, firsts) = self.p, words_in
        b, inside = len(at), np.arange(WINDOW) < n[:, None]
        used, back = np.unique(at, return_inverse=True)
        back = back.reshape(at.shape)
        own = counts[used]
        of = tri[spans(firsts[used], own)]
        owner = np.repeat(np.arange(len(used)), own)
        vec = np.zeros((len(used), 2 * DIM), np.float32)
        vec[:, :DIM] = p["word"][ids[used]]
        np.add.at(vec[:, DIM:], owner, p["gram"][of] / own[owner, None])
        keep = np.ones((b, WINDOW, 2), np.float32)
        keep[..., 0] = drop.random((b, WINDOW)) > 0.5
        keep[..., 1] = drop.random((b, WINDOW)) > 0.1
        keep *= inside[..., None]
        mask = np.repeat(keep, DIM, axis=2)
        x = vec[back] * mask
        states, kept = np.zeros((b, WINDOW, 2 * HIDDEN), np.float32), {}
        for d in "fb":
            h, u = np.zeros((b, HIDDEN), np.float32), p[f"at_{d}"]
            g, part = x @ p[f"in_{d}"] + p[f"bias_{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            kept[d] = []
            for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
                q = h @ u
                zr = sigmoid(g[:, t, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, t, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
                m = inside[:, t, None].astype(np.float32)
                kept[d].append((t, h, z, r, new, q[:, 2 * HIDDEN :], m))
                h = m * (new + z * (h - new)) + (1 - m) * h
                states[:, t, part] = h
        e = states @ p["v"]
        e[~inside] = -30.0
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = (alpha[:, None, :] @ states)[:, 0]
        off = (weight * (sigmoid(pooled @ p["w"] + p["b"]) - label) / weight.sum()).astype(np.float32)
        out = {"w": pooled.T @ off, "b": off.sum(keepdims=True)}
        d_pool = off[:, None] * p["w"]
        d_alpha = (states @ d_pool[..., None])[..., 0]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True)) * inside
        out["v"] = np.einsum("bt,bth->h", d_e, states)
        d_states = alpha[..., None] * d_pool[:, None, :] + d_e[..., None] * p["v"]
        d_x = np.zeros_like(x)
        for d in "fb":
            u, part = p[f"at_{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            d_h, d_u, d_g = np.zeros((b, HIDDEN), np.float32), np.zeros_like(u), np.zeros((b, WINDOW, 3 * HIDDEN), np.float32)
            for t, h, z, r, new, q, m in reversed(kept[d]):
                d_h = d_h + d_states[:, t, part]
                d_out = d_h * m
                d_new = d_out * (1 - z) * (1 - new * new)
                d_z = d_out * (h - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_q = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_g[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u += h.T @ d_q
                d_h = d_h * (1 - m) + d_out * z + d_q @ u.T
            out[f"at_{d}"], out[f"bias_{d}"] = d_u, d_g.sum(axis=(0, 1))
            out[f"in_{d}"] = np.einsum("bti,btj->ij", x, d_g)
            d_x += d_g @ p[f"in_{d}"].T
        d_vec = np.zeros_like(vec)
        np.add.at(d_vec, back.ravel(), (d_x * mask).reshape(-1, 2 * DIM))
        out["word"], out["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(out["word"], ids[used], d_vec[:, :DIM])
        np.add.at(out["gram"], of, (d_vec[:, DIM:] / np.maximum(own, 1)[:, None])[owner])
        return out

    def highest(self, texts: pa.Array) -> np.ndarray:
        """The highest window's logit of each text."""
        if not len(texts):
            return np.empty(0, np.float32)
        words, index, counts = tokens(texts)
        start, size, doc = windows(counts)
        return np.maximum.reduceat(self.logits(words, index, start, size), np.searchsorted(doc, np.arange(len(counts))))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.p:
            return np.zeros(len(texts))
        return sigmoid(self.scale * self.highest(texts).astype(np.float64) + self.shift)


def release() -> None:
    """Gives what training held back to the system, as drivers live long."""
    gc.collect()
    give_back()


def stems(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of ``STEM`` characters of all words, and how many each word has."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(sizes - STEM + 1, 0)
    at = spans(np.cumsum(sizes) - sizes, counts)
    mixed = np.zeros(len(at), np.uint32)
    for k in range(STEM):
        mixed = mixed * np.uint32(0x01000193) ^ points[at + k]
    return (((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(np.log2(STEMS)))).astype(np.int64), counts


def _speaks(toxic: np.ndarray, clean: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of how many toxic and clean documents a thing is in: the number of toxic ones times the
    smoothed log of its odds there; 0 in fewer than two of them."""
    odds = np.log((toxic + 0.5) / ((y == 1).sum() + 1)) - np.log((clean + 0.5) / ((y == 0).sum() + 1))
    return np.where(toxic < 2, 0.0, toxic * np.maximum(odds, 0))


def peculiar(words: pa.Array, index: np.ndarray, counts: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How much each word, or the run of characters in it that says most, speaks for toxic
    documents, by the ``known`` ones; 0 for the padding after the last word."""
    n, (grams_of, own) = len(words), stems(words)
    first, bounds = np.cumsum(own) - own, np.concatenate([[0], np.cumsum(counts)])
    by_word, by_stem = np.zeros((2, n + 1), np.int64), np.zeros((2, STEMS), np.int64)
    for doc in np.flatnonzero(known):
        has = np.unique(index[bounds[doc] : bounds[doc + 1]])
        by_word[y[doc], has] += 1
        by_stem[y[doc], np.unique(grams_of[spans(first[has], own[has])])] += 1
    out = _speaks(by_word[1], by_word[0], y[known])
    stem = np.append(_speaks(by_stem[1], by_stem[0], y[known])[grams_of], 0.0)
    some = np.flatnonzero(own)
    if len(some):
        out[some] = np.maximum(out[some], np.maximum.reduceat(stem, first[some]))
    return out


def train(texts: list[str | None] | pa.Array, labels: list[int] | np.ndarray, seed: int = 7, rounds: int = 5, steps: int = 80, batch: int = 128, rate: float = 0.01, cut: float = 0.7) -> Network:
    """Fits a network to texts (in memory) and their labels."""
    y = np.asarray(labels, np.int64)
    if len(set(y.tolist())) < 2:
        return Network()
    rng, net = np.random.default_rng(seed), Network.new(seed)
    words, index, counts = tokens(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    ids, tri, own = grams(words)
    ids, own = np.append(ids, 0), np.append(own, 0)  # the last one pads
    words_in = (ids, tri, own, np.cumsum(own) - own)
    start, size, doc = windows(counts)
    padded, steps_in = np.append(index, len(words)), np.arange(WINDOW)
    aside = rng.random(len(y)) < 0.2
    fit = ~aside[doc]
    value = peculiar(words, index, counts, y, ~aside)
    placed = np.append(value[index], 0.0)
    best = np.empty(len(start))
    for low in range(0, len(start), 1 << 16):
        here = slice(low, low + (1 << 16))
        best[here] = placed[np.where(steps_in < size[here, None], start[here, None] + steps_in, len(index))].max(axis=1)
    highest = np.zeros(len(y))
    np.maximum.at(highest, doc, best)
    bad, good = np.flatnonzero(fit & (y[doc] == 1) & (best >= 0.7 * highest[doc])), np.flatnonzero(fit & (y[doc] == 0))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for k in range(rounds):
        if k:
            z = net.logits(words, index, start, size)
            order = np.lexsort((-z, doc))
            rank = np.empty(len(z), np.int64)
            rank[order] = spans(np.zeros(len(y), np.int64), np.bincount(doc, minlength=len(y)))
            bad = np.flatnonzero(fit & (y[doc] == 1) & (rank < (3 if k == 1 else 1)))
            hard = np.flatnonzero(fit & (y[doc] == 0) & (rank == 0))
        for _ in range(steps):
            if len(bad) == 0 or len(good) == 0:
                break
            low = rng.choice(good, batch // 4) if k else rng.choice(good, batch // 2)
            pick = np.concatenate([rng.choice(bad, batch // 2), low, *([rng.choice(hard, batch // 4)] if k else [])])
            at = padded[np.where(steps_in < size[pick, None], start[pick, None] + steps_in, len(padded) - 1)]
            # around the words that tell, toxic windows get most of their words from clean ones,
            # so that what they share by chance isn't learned
            own, told = value[at], value[at].max(axis=1, keepdims=True)
            other = at[rng.choice(np.flatnonzero(y[doc[pick]] == 0), len(pick))]
            swap = (y[doc[pick]] == 1)[:, None] & (told > 0) & (own < 0.5 * told) & (rng.random(at.shape) < 0.8) & (at < len(words)) & (other < len(words))
            at = np.where(swap, other, at)
            grads = net.gradients(words_in, at, size[pick], y[doc[pick]].astype(np.float32), np.ones(len(pick), np.float32), rng)
            step += 1
            pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in grads.items():
                g = np.clip(g, -1, 1)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.p[name] -= pace * (first[name] / (np.sqrt(second[name]) + 1e-7) + 0.002 * net.p[name])
    z = net.logits(words, index, start, size)
    top = np.maximum.reduceat(z, np.searchsorted(doc, np.arange(len(y)))).astype(np.float64)
    seen = aside if len(set(y[aside].tolist())) == 2 else np.ones(len(y), bool)
    # the cut lies in the middle of the gap that tells documents apart best; calling a clean
    # document toxic counts three times
    at = np.sort(np.unique(top[seen]))
    mids = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    right = np.array([(y[seen & (top >= m)] == 1).sum() - 3 * (y[seen & (top >= m)] == 0).sum() for m in mids])
    best = np.flatnonzero(right == right.max())
    middle = float((mids[best[0]] + mids[best[-1]]) / 2)
    net.scale = 1.0
    net.shift = float(np.log(cut / (1 - cut))) - middle
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str, accept, most: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of labelled rows that ``accept`` (a condition on doc_id) lets in: at
    most ``most[0]`` of label 0 and ``most[1]`` of label 1, in the order of the hashes of their
    ids and texts, so whatever else is in the tables the same rows are taken. Null labels are
    left out; rows of one id and text count once for a label."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(accept).where("label in (0, 1) and doc_id is not null").distinct()
    parts = [ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k]) for k in (0, 1)]
    # sum(most) ids at most; an id may have many rows, so these are bounded again
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("doc_id", "text", "label").dropDuplicates(["doc_id", "text", "label"])
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    return rows.withColumn("_n", n).where((F.col("_n") <= max(most)) & (F.col("_n") <= F.when(F.col("label") == 0, most[0]).otherwise(most[1]))).drop("_n")


def fit(docs: DataFrame, labels: DataFrame, accept, label: str = "toxic", most: tuple[int, int] = (1500, 1200), most_bytes: int = 48 << 20) -> Network:
    """Trains on the driver on a bounded sample: ``most`` rows of labels 0 and 1, and of each
    label as many whole texts, in the order of their ids' hashes, as begin within
    ``most_bytes``."""
    rows = sample(docs, labels, label, accept, most)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    before = F.sum(size).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most_bytes).drop("_before").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")])
    net = train(rows["text"].combine_chunks(), rows["label"].to_numpy())
    del rows
    release()
    return net


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a column of that name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(shared.value.scores(piece.column(at)))], [*piece.schema.names, name])
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_clean(docs: DataFrame, net: Network, text: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``; columns may have any names."""
    (own,) = named_apart(docs, "_toxic")
    return score(docs, net, text, own).where(F.col(own) < cut).drop(own)
