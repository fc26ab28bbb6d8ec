"""Byte-level BPE encoding and decoding in numpy.

Texts are cut by the split pattern; each different piece of a batch is encoded once. A piece
that is a token is that token. The others stand in matrices, a row a piece, in buckets of
similar length: every round each row merges its leftmost pair of the least rank, ranks being
looked up in a hashed table of pairs, and rows and columns are compacted; a row without a
mergeable pair leaves. Pieces longer than ``LONG`` bytes would make that quadratic, so they
merge through a heap in the same order. Null texts count as empty; an empty text has no ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperlake.llm.common import give_back, slices
from paperlake.llm.tokenfile import spans

NONE = np.int32(2**31 - 1)
LONG = 256
WIDTHS = np.array([3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, LONG])
ROWS = 1 << 15
SLICE_BYTES = 4 << 20
# fixed values: the split pattern whose pieces never cross a single blank from the left, and white space
BLANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_PY = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PairTable:
    """Pair of ids -> rank, by open addressing in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(rank) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slots[rest]] < 0]
            won = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], rank[won]
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``NONE`` where a pair has none; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NONE)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[slots[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = BLANK_PATTERN):
        import regex

        self.ranks = ranks
        self.by_unit = pattern == BLANK_PATTERN
        # white space as Unicode has it, without the four separators that Python adds
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_PY}").replace(r"(?!\S)", f"(?![^{WHITE_PY}])").replace(r"\s", f"[{WHITE_PY}]"))
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        if (self.single < 0).any():
            raise ValueError("every byte must be a token")
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*pairs))) if pairs else None
        self.pair_ranks = {(a, b): r for a, b, r in pairs}

    @classmethod
    def from_file(cls, path: str, pattern: str = BLANK_PATTERN) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    # pieces to ids

    def _heap(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, rank_of = list(range(-1, n - 1)), list(range(1, n + 1)), self.pair_ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank_of.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def _matrix(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, row by row and padded with -1, and how many."""
        n = len(starts)
        out, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        ids = np.full((n, width), -1, np.int32)
        ids[np.repeat(np.arange(n), sizes), spans(np.zeros(n, np.int64), sizes)] = self.single[flat[spans(starts, sizes)]]
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows, lengths = np.arange(n), sizes.copy()
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = least == NONE
            if over.any():
                out[rows[over], : ids.shape[1]], counts[rows[over]] = ids[over], lengths[over]
                stay = ~over
                ids, ranks, rows, lengths, at, least = ids[stay], ranks[stay], rows[stay], lengths[stay], at[stay], least[stay]
            m = len(rows)
            if not m:
                return out, counts
            row = np.arange(m)
            ids[row, at] = least  # a token's id is its rank
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(m, -1)
            lengths = lengths - 1
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(m, -1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            a, b = at[left], at[right]
            new = self.pairs(np.concatenate([ids[left, a - 1], ids[right, b]]), np.concatenate([ids[left, a], ids[right, b + 1]]))
            ranks[left, a - 1], ranks[right, b] = new[: len(left)], new[len(left) :]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of each piece's."""
        n = len(pieces)
        known = np.fromiter((-1 if (r := self.ranks.get(p)) is None else r for p in pieces), np.int64, n)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        counts = np.where(known >= 0, 1, 0)
        flat, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        bucket = np.searchsorted(WIDTHS, sizes)
        for k in np.unique(bucket[(known < 0) & (sizes > 0)]).tolist():
            rows = np.flatnonzero((bucket == k) & (known < 0) & (sizes > 0))
            if k == len(WIDTHS):
                for i in rows.tolist():
                    ids = np.array(self._heap(pieces[i]), np.int32)
                    counts[i] = len(ids)
                    parts.append((np.array([i]), ids))
                continue
            width = int(WIDTHS[k])
            step = max(1, ROWS * 8 // width)
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                ids, found = self._matrix(flat, starts[some], sizes[some], width)
                counts[some] = found
                parts.append((some, ids[np.arange(width) < found[:, None]]))
        firsts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        whole = known >= 0
        out[firsts[whole]] = known[whole]
        for some, ids in parts:
            out[spans(firsts[some], counts[some])] = ids
        return out, counts

    # texts to pieces

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different units, the units of all texts by number, and the texts' bounds in them. A
        unit is a blank and what follows up to the next one: no piece crosses into it from the
        left. Only a blank inside a longer run of white space breaks that; texts with one
        are a unit each."""
        hard = pc.match_substring_regex(texts, f"[{WHITE}] (?:[{WHITE}]|$)").to_numpy(zero_copy_only=False)
        easy = pc.if_else(pa.array(hard), pa.scalar("", texts.type), texts) if hard.any() else texts
        parts = pc.split_pattern(easy, " ")
        offsets = np.asarray(parts.offsets)
        coded = parts.values.dictionary_encode()
        # the first part of a text has no blank before it
        codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        codes = codes + n
        first = offsets[:-1]
        codes[first] -= n
        if hard.any():
            codes[first[hard]] = 2 * n + np.arange(int(hard.sum()))
        used, codes = np.unique(codes, return_inverse=True) if len(codes) else (np.empty(0, np.int64), codes)
        plain = coded.dictionary.take(pa.array(used[used < n]))
        led = coded.dictionary.take(pa.array(used[(used >= n) & (used < 2 * n)] - n))
        led = pc.binary_join_element_wise(pa.scalar("", texts.type), led, pa.scalar(" ", texts.type))
        whole = texts.filter(pa.array(hard)) if hard.any() else pa.array([], texts.type)
        return pa.concat_arrays([plain, led, whole]), codes, offsets

    def _pieces(self, units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different pieces, those of each unit in order, and how many."""
        cut = pc.extract_regex(units, "^(?P<a> ?[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<b>[!-/:-@\\[-`{-~]*)$")
        # a lone blank before marks belongs to them
        simple = pc.is_valid(cut).to_numpy(zero_copy_only=False) & ~pc.match_substring_regex(units, "^ ?[^ A-Za-zÀ-ÖØ-öø-ÿ]|^ $").to_numpy(zero_copy_only=False)
        rest, more, sizes = np.flatnonzero(~simple), [], []
        for text in units.take(pa.array(rest)).to_pylist():
            own = self.pattern.findall(text)
            more += own
            sizes.append(len(own))
        counts = np.full(len(units), 2, np.int64)
        counts[rest] = sizes
        firsts = np.cumsum(counts) - counts
        kept = pa.array(np.flatnonzero(simple))
        coded = pa.concat_arrays([pc.struct_field(cut, "a").take(kept), pc.struct_field(cut, "b").take(kept), pa.array(more, units.type)]).dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(kept)
        flat = np.empty(int(counts.sum()), np.int64)
        flat[firsts[simple]], flat[firsts[simple] + 1] = codes[:n], codes[n : 2 * n]
        flat[spans(firsts[rest], counts[rest])] = codes[2 * n :]
        return coded.dictionary, flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.by_unit:
            units, index, bounds = self._units(texts)
        else:
            units, index, bounds = texts, np.arange(len(texts)), np.arange(len(texts) + 1)
        pieces, flat, counts = self._pieces(units) if self.by_unit else self._findall(units)
        ids, sizes = self.encode_pieces(pieces.cast(pa.large_binary()).to_pylist())
        of_units = ids[spans((np.cumsum(sizes) - sizes)[flat], sizes[flat])]
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])])
        out = of_units[spans((np.cumsum(lengths) - lengths)[index], lengths[index])]
        return out, np.diff(np.concatenate([[0], np.cumsum(lengths[index])])[bounds])

    def _findall(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        own = [self.pattern.findall(t) for t in texts.to_pylist()]
        coded = pa.array([p for ps in own for p in ps], texts.type).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.array([len(ps) for ps in own], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; of several texts' ids in a row they follow each other."""
        return self.token_bytes[spans(self.token_starts[ids], self.token_sizes[ids])].tobytes()

    def decoded_sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.token_sizes[ids]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = BLANK_PATTERN) -> Codec:
    """One per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec.from_file(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str = BLANK_PATTERN, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as ``name``; a column of that name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at, SLICE_BYTES):
                ids, counts = codec(path, pattern).encode(piece.column(at))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*piece.schema.names, name])
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def digests(docs: DataFrame, path: str, pattern: str = BLANK_PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes). A row for each
    row of ``docs``, repeated and null ids too."""
    rows = docs.select(doc_id, text)
    schema = T.StructType([rows.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                bpe = codec(path, pattern)
                ids, counts = bpe.encode(piece.column(1))
                packed, decoded = ids.astype("<u4").tobytes(), bpe.decode(ids)
                ends = np.cumsum(counts)
                cuts = np.concatenate([[0], np.cumsum(bpe.decoded_sizes(ids))])[np.concatenate([[0], ends])].tolist()
                bounds = [0, *ends.tolist()]
                of_ids = [hashlib.sha256(memoryview(packed)[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
                of_text = [hashlib.sha256(memoryview(decoded)[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts), pa.array(of_ids), pa.array(of_text)], schema.names)
            give_back()

    return rows.mapInArrow(run, schema)
