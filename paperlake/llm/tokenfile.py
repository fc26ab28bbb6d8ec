"""Token ids in binary files of independent zstandard frames with a seek table.

File: data frames, then one skippable frame (magic 0x184D2A5E) that holds the seek table:
per frame compressed size, uncompressed size and checksum (low 32 bits of the XXH64 of the
content), then the number of frames, a descriptor byte (0x80: checksums) and the magic
0x8F92EAB1, all little-endian. A second skippable frame (magic 0x184D2A5C) before it holds
the document index: per document the frame, the offset in it and the number of ids. Each
frame has a checksum of its own too. A reader takes the tail, then only the frames that hold
the documents it was asked for. Documents may span no frames: a frame ends after the document
that fills it, so its size is bounded by ``frame_ids`` and the longest document.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import give_back, new_path, slices, stored, whole_numbers

SEEK_MAGIC, SEEK_FOOT, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5C
FRAME_IDS = 1 << 16
SLICE_BYTES = 4 << 20
CACHED_PIECES, CACHED_LENGTH = 300_000, 48
#: Documents in a row of the manifest, and bytes of text that a file is made for.
LISTED, FILE_BYTES = 8192, 128 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of ``file:///...``, ``hdfs://...`` and others of Arrow's."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


class Writer:
    """Appends documents; ``close`` writes the rest, the index and the seek table."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.ids, self.held, self.frames, self.index = [], 0, [], []

    def add(self, ids: np.ndarray) -> None:
        self.index.append((len(self.frames), self.held, len(ids)))
        self.ids.append(ids.astype("<u4"))
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        data = np.concatenate(self.ids).tobytes() if self.ids else b""
        packed = self.pack.compress(data)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.out.write(packed)
        self.ids, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = np.array(self.index, "<u4").reshape(-1, 3).tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOT)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)


class Reader:
    """Random access to one file; ``source`` has read, seek and size."""

    def __init__(self, source):
        self.source, size = source, source.size()
        frames, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOT or flag != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        head = size - 9 - 12 * frames - 8
        if struct.unpack("<II", self._at(head, 8)) != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(head + 8, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        end = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(end, 8))
        if magic != INDEX_MAGIC or end + 8 + length != head:
            raise ValueError("the document index is damaged")
        self.index = np.frombuffer(self._at(end + 8, length), "<u4").reshape(-1, 3).astype(np.int64)
        self.unpack, self.last = zstandard.ZstdDecompressor(), (-1, np.empty(0, "<u4"))

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            packed, length, digest = self.frames[k].tolist()
            data = self.unpack.decompress(self._at(int(self.starts[k]), packed), max_output_size=length)
            if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != digest:
                raise ValueError(f"frame {k} fails its checksum")
            self.last = (k, np.frombuffer(data, "<u4"))
        return self.last[1]

    def document(self, i: int) -> np.ndarray:
        k, start, n = self.index[i].tolist()
        return self.frame(k)[start : start + n] if n else np.empty(0, "<u4")

    def __len__(self) -> int:
        return len(self.index)

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(self.document, range(len(self)))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordEncoder:
    """Ids of whole texts, each piece of a word encoded once and then looked up.

    The tokenizer's pattern drops white space, so its result for a text is that for the runs
    between blanks, in order; Arrow tells them apart. Runs of ASCII and Latin-1 letters need
    no normalising but lower case: these are cut by the tokenizer's own pattern here (letters
    and then marks without Python, others with ``re``) and their pieces go to its merge model
    alone. All other runs, and those that hold a special token, go through the whole
    tokenizer. A file with another normalizer or pattern, or with special tokens that look
    beyond their own characters, is given whole texts. Special tokens in a text are found as
    the library does by default, or are plain text if ``special_as_text``. ``known`` and
    ``old``: generations of a bounded cache.
    """

    # fixed values: what the file must hold for words to be independent
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        said = json.loads(self.whole.to_str())
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])] == self.NORMALIZERS and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": self.PATTERN} and not steps[1]["add_prefix_space"]
        added = said.get("added_tokens") or []
        self.special = [a["content"] for a in added if not (special_as_text and a["special"])]
        self.by_word = self.by_word and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or a["content"].split() != [a["content"]] for a in added)
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
        # the byte-level alphabet: printable bytes stand for themselves, others follow from 256
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b if b in shown else 256 + hidden.index(b) for b in range(256)}

    def _learn(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of pieces; one that starts with a blank is a run for the whole tokenizer."""
        plain = [p for p in pieces if p[0] != " "]
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet) for p in plain]
        groups = [shown[i : i + 1024] for i in range(0, len(shown), 1024)]
        found = {}
        for i, e in enumerate(self.merges.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids, counts = e.ids, np.bincount(np.array(e.word_ids, np.int64), minlength=len(groups[i]))
            ends = np.cumsum(counts)
            for p, low, high in zip(plain[1024 * i : 1024 * (i + 1)], (ends - counts).tolist(), ends.tolist()):
                found[p] = tuple(ids[low:high])
        others = [p for p in pieces if p[0] == " "]
        found.update((p, tuple(e.ids)) for p, e in zip(others, self.whole.encode_batch_fast([p[1:] for p in others], add_special_tokens=False)))
        return [found[p] for p in pieces]

    def _ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        known, old = self.known, self.old
        out = [() if p == "" else known.get(p) or old.get(p) for p in pieces]
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(new, self._learn([pieces[i] for i in new])):
            out[i] = ids
        known.update((p, ids) for p, ids in zip(pieces, out) if 0 < len(p) <= CACHED_LENGTH)
        if len(known) > CACHED_PIECES:
            self.old, self.known = known, {}
        return out

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different pieces of ``words``, those of each word in order, and how many."""
        low = pc.utf8_lower(words)
        cut = pc.extract_regex(low, "^(?P<a>[a-zß-öø-ÿ]*)(?P<b>[!-/:-`{-~]*)$")
        simple = pc.is_valid(cut).to_numpy(zero_copy_only=False) & pc.match_substring_regex(words, "^[!-~À-ÖØ-öø-ÿ]*$").to_numpy(zero_copy_only=False)
        special = np.zeros(len(words), bool)
        for content in self.special:
            special |= pc.match_substring(words, content).to_numpy(zero_copy_only=False)
        simple &= ~special
        rest, more, sizes = np.flatnonzero(~simple), [], []
        if len(rest):
            taken = words.take(pa.array(rest))
            for word, plain, whole in zip(taken.to_pylist(), pc.match_substring_regex(taken, "^[!-~À-ÖØ-öø-ÿ]*$").to_pylist(), special[rest].tolist()):
                own = self.pieces(word.lower()) if plain and not whole else [" " + word]
                more += own
                sizes.append(len(own))
        counts = np.full(len(words), 2, np.int64)
        counts[rest] = sizes
        firsts = np.cumsum(counts) - counts
        kept = pa.array(np.flatnonzero(simple))
        coded = pa.concat_arrays([pc.struct_field(cut, "a").take(kept), pc.struct_field(cut, "b").take(kept), pa.array(more, words.type)]).dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(kept)
        flat = np.empty(int(counts.sum()), np.int64)
        flat[firsts[simple]], flat[firsts[simple] + 1] = codes[:n], codes[n : 2 * n]
        flat[spans(firsts[rest], counts[rest])] = codes[2 * n :]
        return coded.dictionary, flat, counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            found = self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32), np.array([len(e.ids) for e in found], np.int64)
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        words = pc.split_pattern(texts, " ")
        coded = words.values.dictionary_encode()
        pieces, flat, counts = self._pieces(coded.dictionary)
        gc.disable()  # thousands of live tuples and no cycles
        try:
            of = self._ids_of(pieces.to_pylist())
            sizes = np.fromiter(map(len, of), np.int64, len(of))
            ids = np.fromiter(chain.from_iterable(of), np.uint32, int(sizes.sum()))
        finally:
            gc.enable()
        # ids of pieces, then of different words, then of all words
        of_words = ids[spans((np.cumsum(sizes) - sizes)[flat], sizes[flat])]
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])])
        index = coded.indices.to_numpy()
        out = of_words[spans((np.cumsum(lengths) - lengths)[index], lengths[index])]
        bounds = np.concatenate([[0], np.cumsum(lengths[index])])[np.asarray(words.offsets)]
        return out, np.diff(bounds)


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One per Python worker, so that what it learned serves later tasks too."""
    if (path, special_as_text) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, special_as_text] = WordEncoder(path, special_as_text)
    return _encoders[path, special_as_text]


MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("documents", T.LongType()), T.StructField("ids", T.LongType())])
_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("documents", pa.int64()), ("ids", pa.int64())])
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
_ROWS = pa.schema([(f.name, pa.int64()) for f in ROWS])


def write(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, files: int | None = None, frame_ids: int = FRAME_IDS, special_as_text: bool = False) -> DataFrame:
    """Writes the ids of all rows in ascending order of doc_id (whole numbers; null first; rows of one id by
    the hash of their text) and returns the manifest, itself stored in the shared folder: a
    row for every ``LISTED`` documents of a file, with their ids and the number of the first.
    Null and empty texts have ``end_id`` alone. ``files``: by default one for each shuffle
    partition, more if a file would hold over ``FILE_BYTES`` of text; a repeated id is spread
    over files by the hash. A task writes under a name of its own and attempt, so only files
    of tasks that ended well are listed. Extra columns are not looked at; an empty table gives
    an empty manifest."""
    whole_numbers(docs, doc_id)
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches: Iterable[pa.RecordBatch]):
        task, encode, writer, ids, first, total, out = TaskContext.get(), None, None, [], 0, 0, None
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        listed = lambda: pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": path, "first": first, "doc_ids": ids, "documents": len(ids), "ids": total}], _MANIFEST)
        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                if writer is None:
                    fs, at = open_fs(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    writer, encode = Writer(out, frame_ids), encoder(tokenizer, special_as_text)
                found, counts = encode(piece.column(1))
                for own, part in zip(piece.column(0).to_pylist(), np.split(found, np.cumsum(counts)[:-1])):
                    if len(ids) == LISTED:
                        yield listed()
                        first, ids, total = first + len(ids), [], 0
                    writer.add(np.append(part, np.uint32(end_id)))
                    ids.append(own)
                    total += len(part) + 1
            give_back()
        if writer is not None:
            writer.close()
            out.close()
            yield listed()

    return stored(rows.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, each taken from
    the files. Tasks get about as many rows of the manifest as a file has; each holds one
    frame and one row's results at a time."""
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("_n"))
    # a row for each file
    totals = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    own = F.sum("ids").over(Window.partitionBy("part").orderBy("first")) - F.col("ids")
    tasks = manifest.withColumn("_own", own).join(F.broadcast(totals), "part").select("part", "path", "first", "doc_ids", F.col("ids").alias("total"), (F.col("_own") + F.col("_base")).alias("base"))
    tasks = tasks.repartitionByRange(max(1, manifest.select("part").distinct().count()), "part", "first")

    def run(batches):
        path, reader, source = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if source is not None:
                        source.close()
                    fs, at = open_fs(row["path"])
                    source, path = fs.open_input_file(at), row["path"]
                    reader = Reader(source)
                start, first, out = row["base"], row["first"], []
                if first + len(row["doc_ids"]) > len(reader):
                    raise ValueError(f"{path} has {len(reader)} documents, its manifest {first + len(row['doc_ids'])}")
                for i, doc_id in enumerate(row["doc_ids"], first):
                    ids = reader.document(i)
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if start - row["base"] != row["total"]:
                    raise ValueError(f"{path} has {start - row['base']} ids, its manifest {row['total']}")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_ROWS)
        if source is not None:
            source.close()

    return tasks.mapInArrow(run, ROWS)


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in ``doc_ids`` (column doc_id), from their frames alone."""
    asked = manifest.select("path", "first", F.posexplode("doc_ids").alias("at", "doc_id")).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = asked.groupBy("path", "first").agg(F.sort_array(F.collect_list(F.struct((F.col("first") + F.col("at")).alias("at"), "doc_id"))).alias("asked"))  # LISTED at most

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    for x in row["asked"]:
                        yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"]], pa.int64()), pa.array([reader.document(x["at"]).astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return asked.mapInArrow(run, "doc_id long, ids array<long>")
