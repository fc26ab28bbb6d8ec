"""Best-fit packing of token pieces into sequences, improved by swaps.

Documents are tokenised once; those longer than a sequence are cut into whole sequences and a
last, shorter piece, and no other is cut. Pieces are dealt at random into groups of about
``GROUP_ROWS``, which are packed side by side: best fit gives a first packing, then a local
search between underfull bins (``Search``) moves a document into a fuller bin, or exchanges
one or two documents of the emptier bin for one of the fuller, whenever the sum of squared
fills grows; so the emptiest bins run empty. It ends when no bin can be saved, by a lower bound
on bins, or when no exchange is left. Bins of a group that stay underfull meet those of other
groups in a next round, which carries on from them, until one group holds what is left or a
round saves no bin.

Tasks hold lengths and numbers of one group, never tokens. Pieces of equal documents, null ids
and repeated ids are numbered one by one and dealt like others, so no group grows with them.
Null texts count as empty: one piece of one token, the end id. An empty table gives no rows.
Only the two named columns are read, whatever others a table has.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import give_back, slices, stored
from paperlake.llm.tokenfile import SLICE_BYTES, encoder

LENGTH = 4096
#: Pieces in a group, about; bins below this share of a sequence go on to a next round.
GROUP_ROWS, SHORT_OF = 1 << 15, 0.995
#: Documents that a search looks at for each one of its group, before it ends with the packing
#: that it has; this bounds its time, not what is packed.
EFFORT = 1000


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A stored row for each piece: at (a number that no other piece has), doc_id, piece (from
    0), start, length, ids_crc32, and ``ids`` themselves if asked for. Texts are taken whole,
    and every document ends with ``end_id``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("at", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]):
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                found, counts = encoder(tokenizer)(part.column(1))
                ends = np.cumsum(counts)
                found = np.insert(found, ends, end_id).astype("<u4")
                counts = counts + 1
                per = -(-counts // length)
                doc = np.repeat(np.arange(len(counts)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                sizes = np.minimum(length, counts[doc] - piece * length)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                data = memoryview(found).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [pa.array(at + np.arange(len(doc))), part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(doc)
            give_back()

    return stored(rows.mapInArrow(run, T.StructType(fields)), "pieces")


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins that ``sizes`` need: of all thresholds k, those too large to
    share with anything of at least k, plus what the mid-sized leave of the rest."""
    if not len(sizes):
        return 0
    of = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    count, total = np.concatenate([[0], np.cumsum(of)]), np.concatenate([[0], np.cumsum(of * np.arange(len(of)))])
    k, half = np.arange(0, capacity // 2 + 1), capacity // 2
    large = count[-1] - count[capacity - k + 1]
    mid, mid_sum = count[capacity - k + 1] - count[half + 1], total[capacity - k + 1] - total[half + 1]
    small = total[half + 1] - total[k]
    more = np.maximum(0, -(-(small - (mid * capacity - mid_sum)) // capacity))
    return int((large + mid + more).max())


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, longest first, each into the fullest bin that takes it."""
    out = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            own, room, bins = bins, capacity, bins + 1
        out[i] = own
        if room > size:
            by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return out


class Search:
    """Local search between underfull bins of one group. ``bin_of`` holds the bin of each size;
    every step takes documents from the emptier of two bins to the fuller one, by which the sum
    of squared fills grows, so it ends."""

    def __init__(self, sizes: np.ndarray, bin_of: np.ndarray, capacity: int, effort: int = EFFORT):
        self.steps = effort * len(sizes)
        self.sizes, self.bin_of, self.capacity = sizes, bin_of, capacity
        self.fill = np.bincount(bin_of, sizes, int(bin_of.max(initial=-1)) + 1).astype(np.int64)
        self.left = int((self.fill > 0).sum()) - least_bins(sizes, capacity)
        own = np.flatnonzero(self.fill[bin_of] < capacity)
        order = own[np.argsort(bin_of[own], kind="stable")]
        cuts = np.flatnonzero(np.diff(bin_of[order])) + 1
        self.items = {int(bin_of[g[0]]): g.tolist() for g in np.split(order, cuts) if len(g)}
        #: Underfull bins by room, and documents of underfull bins by what could replace them.
        self.by_room = sorted((capacity - int(self.fill[b]), b) for b in self.items)
        self.by_reach = sorted((int(sizes[i]) + capacity - int(self.fill[b]), i) for b, own in self.items.items() for i in own)

    def _index(self, b: int, add: bool) -> None:
        room = self.capacity - int(self.fill[b])
        keys = [(self.by_room, (room, b)), *((self.by_reach, (int(self.sizes[i]) + room, i)) for i in self.items[b])]
        for where, key in keys:
            at = bisect.bisect_left(where, key)
            if add:
                where.insert(at, key)
            else:
                del where[at]

    def _exchange(self, source: int, target: int, give: list[int], take: list[int]) -> None:
        for b in (source, target):
            self._index(b, False)
        for b, out, new in ((source, give, take), (target, take, give)):
            own = [i for i in self.items[b] if i not in out] + new
            self.items[b] = own
            self.bin_of[own] = b
            self.fill[b] += sum(int(self.sizes[i]) for i in new) - sum(int(self.sizes[i]) for i in out)
        for b in (source, target):
            if not self.items[b]:
                del self.items[b]
                self.left -= 1
            elif self.fill[b] < self.capacity:
                self._index(b, True)
            else:
                del self.items[b]

    def _move(self, source: int) -> bool:
        """Gives a document of ``source`` to the fullest other bin that has room for it."""
        least = int(self.fill[source])
        for i in sorted(self.items[source], key=lambda i: (-self.sizes[i], i)):
            for at in range(bisect.bisect_left(self.by_room, (int(self.sizes[i]), -1)), len(self.by_room)):
                room, b = self.by_room[at]
                if self.capacity - room < least:
                    break
                if b != source:
                    self._exchange(source, b, [i], [])
                    return True
        return False

    def _swap(self, source: int, both: bool) -> bool:
        """Gives one document of ``source``, or two, for a smaller one of a fuller bin, such
        that this bin becomes as full as can be."""
        least, seen, offers = int(self.fill[source]), {}, {}
        for i in self.items[source]:
            seen.setdefault(int(self.sizes[i]), []).append(i)
        different = sorted(seen, reverse=True)
        if both:
            for k, a in enumerate(different):
                for b in different[k:]:
                    if a != b or len(seen[a]) > 1:
                        offers.setdefault(a + b, [seen[a][0], seen[b][-1]])
        else:
            offers = {a: [seen[a][0]] for a in different}
        best = None
        for total, give in offers.items():
            for at in range(bisect.bisect_left(self.by_reach, (total, -1)), len(self.by_reach)):
                reach, j = self.by_reach[at]
                self.steps -= 1
                if best is not None and reach - total >= best[0]:
                    break
                b = int(self.bin_of[j])
                if b != source and self.sizes[j] < total and self.fill[b] >= least:
                    best = (reach - total, give, j, b)
                    break
            if self.steps < 0 or best is not None and best[0] == 0:
                break
        if best is None:
            return False
        self._exchange(source, best[3], best[1], [best[2]])
        return True

    def run(self) -> np.ndarray:
        """Gives from the emptiest bins first, as long as a bin can be saved and some exchange
        is left."""
        changed = True
        while changed:
            changed = False
            for source in sorted(self.items, key=lambda b: (self.fill[b], b)):
                while source in self.items and self.left > 0 and self.steps >= 0 and (self._move(source) or self._swap(source, False) or self._swap(source, True)):
                    changed = True
        return self.bin_of


def search(sizes: np.ndarray, bins: np.ndarray | None, capacity: int) -> np.ndarray:
    """The bin of each size, from 0 without gaps; ``bins``: a packing to start from."""
    start = best_fit(sizes, capacity) if bins is None else np.unique(bins, return_inverse=True)[1]
    return np.unique(Search(sizes, start.astype(np.int64), capacity).run(), return_inverse=True)[1]


def _round(rows: DataFrame, groups: int, base: int, capacity: int, key: str) -> DataFrame:
    """Packs the pieces of each group; those of one bin in ``key`` meet in one group. Groups
    hold about ``GROUP_ROWS`` rows, as keys are dealt by their hash."""
    started = "sequence_id" in rows.columns
    added = ["sequence_id", "offset", "fill"]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in added], *[T.StructField(n, T.LongType()) for n in added]])

    def pack(table: pa.Table) -> pa.Table:
        group = base + table["_group"][0].as_py()
        table = table.sort_by("at")
        sizes = table["length"].to_numpy().astype(np.int64)
        own = search(sizes, table["sequence_id"].to_numpy() if started else None, capacity)
        fill = np.bincount(own, sizes).astype(np.int64)
        # places: running sums bin by bin, less what the bins before hold
        order, offset = np.argsort(own, kind="stable"), np.empty(len(own), np.int64)
        offset[order] = np.cumsum(sizes[order]) - sizes[order]
        offset -= (np.cumsum(fill) - fill)[own]
        columns = [table[n] for n in schema.names[:-3]]
        return pa.Table.from_arrays([*columns, pa.array((group << 32) + own), pa.array(offset), pa.array(fill[own])], names=schema.names)

    dealt = rows.drop("offset", "fill").withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, schema)


def packed(found: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``found`` (a stored table with at, length; its other columns stay) with ``sequence_id``
    (any numbers) and ``offset``, the place in the sequence, gapless from 0."""
    whole = found.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("at")).withColumn("offset", F.lit(0).cast("long"))
    rest = found.where(F.col("length") < length)
    n = rest.count()
    if not n:
        return whole
    base, groups = 1, max(1, -(-n // group_rows))
    rows, done = stored(_round(rest, groups, base, length, "at"), "packed"), []
    while groups > 1:
        short = F.col("fill") < int(SHORT_OF * length)
        done.append(rows.where(~short))
        again = rows.where(short)
        size = again.agg(F.count("*").alias("n"), F.count_distinct("sequence_id").alias("bins")).first()
        base, groups = base + groups, max(1, -(-size["n"] // group_rows))
        rows = stored(_round(again, groups, base, length, "sequence_id"), "packed")
        if rows.select("sequence_id").distinct().count() >= size["bins"]:
            break
    done.append(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return whole.unionByName(out.drop("fill"))


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, from pieces ``with_ids``."""
    both = found.select("at", "ids").join(placed.select("at", "sequence_id", "offset"), "at")
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # a sequence's tokens at most
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
