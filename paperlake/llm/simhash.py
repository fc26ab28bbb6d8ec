"""SimHash near-duplicates, found by an index of one-wildcard segment variants.

Fingerprint: ASCII letters are lower-cased, words are the runs between ASCII white space,
every run of ``shingle`` words (all words, if fewer) joined by blanks is hashed with XXH64
(seed 42); a bit of the fingerprint is one if it is set in over half the hashes, repeats
counted. Null and empty texts, and texts of white space alone, have fingerprint zero and are
linked like any other. Texts may have any length: hashes are counted in blocks.

Search: if two fingerprints differ in at most ``distance`` bits, then of more than
``distance / 2`` segments at least one differs in at most one bit. So the 64 bits are cut
into ``distance // 2 + 1`` segments, each is indexed once for every one of its bits with that
bit masked, and an equality join of these variants meets every such pair; the true distance
is checked in the join. A variant that more than ``hot`` fingerprints share is not paired at
all: its fingerprints are put on every point that differs from them in at most
``distance // 2`` bits instead, and hung on the smallest one there. Two fingerprints link
through such a midpoint exactly if they differ in at most ``distance`` bits (for an even
distance), so components stay exact and the work stays linear.

Similar texts (``keep_one``): two texts are near copies if the Jaccard index of their sets of
five-word shingles is 0.8 or more. Their candidates come from the same kind of index over a
wider fingerprint of ``SEGMENTS`` times ``WIDTH`` bits, taken over the different pairs of
neighbouring words, which keep more of an edited text than five words do: a segment is cut
for each chance, and each has one wildcard. If a bit differs with chance p, a segment meets
with q = (1 - p) ** 24 + 24 p (1 - p) ** 23 and a pair with 1 - (1 - q) ** 8: about 0.95 at
an index of 0.80, 0.98 at 0.85, 0.99 at 0.90. The exact index decides afterwards.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import components, give_back, named_apart, saved, shuffled, slices, stored

BITS = 64
BLOCK = 1 << 15
#: The wider fingerprint; ``WIDTH`` bits tell 2 ** (WIDTH - 1) texts apart in each variant.
SEGMENTS, WIDTH, WORDS_EACH = 8, 24, 2
#: Of the wider fingerprint's bits so many may differ in a candidate: near copies have about
#: 18 (standard deviation 4) at an index of 0.8, other texts 96 (7).
MOST_DIFFERENT = 56
#: Keys and nodes up to so many are broadcast after they were counted.
FEW = 500_000


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    starts, ends = at[:-shingle], at[shingle:] - 1
    ones, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist())], np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "simhash", shingle: int = 4) -> DataFrame:
    """``docs`` and a signed BIGINT column ``name``; a column of that name is replaced."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at):
                prints = np.array([fingerprint(t, shingle) for t in piece.column(at).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(prints)], [*piece.schema.names, name])
            give_back()

    return docs.mapInArrow(run, schema)


def links(prints: DataFrame, name: str = "simhash", distance: int = 4, hot: int = 2048) -> DataFrame:
    """Rows (a, b) of distinct fingerprints whose components are those of all pairs that
    differ in at most ``distance`` bits; no pair beyond that is given. See the module."""
    if distance % 2:
        raise ValueError("an even distance is needed")
    fp = F.col("fp")
    prints = spread(prints.select(F.col(name).alias("fp")).distinct())
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    firsts, variants = [], []
    for low, high in zip(cuts, cuts[1:]):
        firsts.append(len(variants))
        variants += [(low, high, bit) for bit in range(high - low)]
    keys = []
    for i, (low, high, bit) in enumerate(variants):
        mask = ((1 << (high - low)) - 1) & ~(1 << bit)
        keys.append(F.lit(i << 40).cast("long").bitwiseOR(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(mask).cast("long"))))
    index = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    crowded = few_or_shuffled(saved(crowded))
    rest = index.join(crowded, "key", "left_anti")
    # the explode made many keys of each fingerprint, which Spark doesn't count
    x, y = rest.alias("x"), shuffled(rest).alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    number = F.shiftright(F.col("x.key"), 40)
    # equal segments meet in each of their variants: the first one counts
    wide = F.lit(False)
    for first, low, high in zip(firsts, cuts, cuts[1:]):
        inside = (number >= first) & (number < first + high - low)
        same = F.shiftrightunsigned(differ, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")) == 0
        wide = wide | (inside & (~same | (number == first)))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(differ) <= distance) & wide).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = [0] + [sum(1 << i for i in c) for k in range(1, distance // 2 + 1) for c in combinations(range(BITS), k)]
    flips = [f - (1 << BITS) if f >= 1 << (BITS - 1) else f for f in flips]
    dense = index.join(crowded, "key", "left_semi").select("fp").distinct()
    points = dense.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    stars = points.join(shuffled(hubs), "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars)


def few_or_shuffled(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` as a side of a join: broadcast if they were counted to be few."""
    return F.broadcast(rows) if rows.count() <= FEW else shuffled(rows)


def spread(rows: DataFrame) -> DataFrame:
    """Few narrow rows over all cores, before each becomes many."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4, hot: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, simhash, root, component_id.

    ``component_id`` is the smallest doc_id reachable by links, null if all are null;
    ``root`` names the component (its smallest fingerprint). Repeated rows, also of one id,
    are kept as they are; an empty table gives none.
    """
    prints = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(with_fingerprints(prints, shingle=shingle).drop("text"), "simhash")
    return with_components(prints, distance, hot)


def with_components(prints: DataFrame, distance: int = 4, hot: int = 2048) -> DataFrame:
    """Adds ``root`` and ``component_id`` to rows with ``doc_id`` and ``simhash``."""
    # an exact copy has its original's fingerprint: these meet here, before any join
    firsts = saved(prints.groupBy("simhash").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts, distance=distance, hot=hot))
    of = firsts.join(shuffled(roots), F.col("simhash") == F.col("node"), "left").select("simhash", "first", F.coalesce("root", "simhash").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = saved(of.join(shuffled(smallest), "root").select("simhash", "root", "component_id"))
    return prints.join(shuffled(of), "simhash")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def runs(words: list[bytes], size: int) -> np.ndarray:
    """The different hashes of all runs of ``size`` words; of all words if these are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, 42)], np.uint64)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    hashes = (digest(line[a:b], 42) for a, b in zip(at[:-size].tolist(), (at[size:] - 1).tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - size + 1))


def segments(hashes: np.ndarray) -> list[int]:
    """The wider fingerprint, a number of ``WIDTH`` bits for each segment."""
    ones = np.zeros(SEGMENTS * WIDTH, np.int64)
    each = WIDTH // 4  # bytes of two segments
    for i in range(0, len(hashes), BLOCK):
        h, parts = hashes[i : i + BLOCK], []
        for _ in range(SEGMENTS // 2):
            # the next 64 bits by a bijection that mixes all of them
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
            parts.append(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :each])
        ones += np.unpackbits(np.hstack(parts), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).reshape(SEGMENTS, WIDTH)
    return (bits @ (1 << np.arange(WIDTH))).tolist()


def _mapped(rows: DataFrame, schema: str, run) -> DataFrame:
    """(rows without ``text``, columns ``schema``) that ``run`` makes of a list of texts."""
    at = rows.columns.index("text")
    names = [c.split()[0] for c in schema.split(", ")]
    kept = [i for i, c in enumerate(rows.columns) if c != "text"]
    out = ", ".join([f"`{rows.schema[i].name}` {rows.schema[i].dataType.simpleString()}" for i in kept] + [schema])

    def batches(parts):
        for whole in parts:
            for batch in slices(whole, at):
                arrays = run(batch.column(at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *arrays], [*[batch.schema.names[i] for i in kept], *names])
            give_back()

    return rows.mapInArrow(batches, out)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def with_segments(rows: DataFrame) -> DataFrame:
    """(rows without ``text``, node, segs): the node is the XXH64 of a text's words, so texts
    that differ in white space or in the case of ASCII letters are one node; 0 without words,
    and then no segments."""

    def run(texts):
        words = [words_of(t) for t in texts]
        nodes = [xxhash.xxh64_intdigest(b" ".join(w), 42) if w else 0 for w in words]
        return [pa.array(_signed(nodes)), pa.array([segments(runs(w, WORDS_EACH)) if w else [] for w in words], pa.list_(pa.int32()))]

    return _mapped(rows, "node long, segs array<int>", run)


def with_shingles(rows: DataFrame, shingle: int) -> DataFrame:
    return _mapped(rows, "shingles array<long>", lambda texts: [pa.array([runs(words_of(t), shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))])


def _cells(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, cell) of ``nodes``; the cells with their number of nodes and two of them; pairs
    (x, y) of cells that differ in one bit."""
    cell = [F.get("segs", s).cast("long").bitwiseOR(F.lit(s << WIDTH).cast("long")) for s in range(SEGMENTS)]
    member = nodes.where(F.size("segs") > 0).select("node", F.explode(F.array(*cell)).alias("cell"))
    sizes = saved(member.groupBy("cell").agg(F.count("*").alias("c"), F.min("node").alias("a"), F.max("node").alias("b")))
    keys = [F.col("cell").bitwiseAND(F.lit(~(1 << bit)).cast("long")).bitwiseOR(F.lit(bit << 32).cast("long")) for bit in range(WIDTH)]
    index = spread(sizes.select("cell")).select("cell", F.explode(F.array(*keys)).alias("key"))
    next_to = saved(index.groupBy("key").agg(F.min("cell").alias("x"), F.max("cell").alias("y")).where("x <> y").select("x", "y"))
    return member, sizes, next_to


def unmet(nodes: DataFrame, roots: DataFrame, cells: tuple[DataFrame, DataFrame, DataFrame], hot: int = 4, part: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Where ``candidates`` left pairs to hubs that can still bring a link that joins components:
    pairs (x, y) of cells, equal ones for a cell itself, with their commonest component and a
    number of parts of about ``part`` nodes; and (cell, node, root) of the nodes there.

    A large cell, or it and one that differs in a bit, is done if it is of one component."""
    member, sizes, next_to = cells
    large = sizes.where(F.col("c") > hot).select("cell")
    beside = next_to.join(shuffled(large.select(F.col("cell").alias("x"))), "x", "left_semi").union(next_to.join(shuffled(large.select(F.col("cell").alias("y"))), "y", "left_semi").select("x", "y")).distinct()
    groups = large.select(F.col("cell").alias("x"), F.col("cell").alias("y")).union(beside)
    # a component's nodes of a cell are counted before cells meet
    asked = groups.select(F.explode(F.array("x", "y")).alias("cell")).distinct()
    of = saved(member.join(shuffled(asked), "cell").join(shuffled(roots), "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root")))
    counted = saved(of.groupBy("cell", "root").agg(F.count("*").alias("n")))
    ends = groups.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("cell"))
    tally = ends.join(shuffled(counted), "cell").groupBy("x", "y", "root").agg(F.sum("n").alias("n"))
    tally = tally.groupBy("x", "y").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    return saved(tally.where("roots > 1").select("x", "y", "most", F.ceil(F.col("n") / part).cast("int").alias("parts"))), of


def left_over(nodes: DataFrame, roots: DataFrame, cells: tuple[DataFrame, DataFrame, DataFrame], hot: int = 4, part: int = 1024) -> DataFrame:
    """(a, b): all pairs of ``nodes`` that ``candidates`` left to hubs and whose roots differ, in
    the plain form that tests hold ``sharing`` against: it grows with the square of a group.

    The nodes outside a group's commonest component meet all nodes, dealt in parts, so no task
    holds a whole cell."""
    open_, of = unmet(nodes, roots, cells, hot, part)
    ends = open_.select("x", "y", "most", "parts", F.explode(F.array_distinct(F.array("x", "y"))).alias("cell"))
    all_ = ends.join(of, "cell")
    few = all_.where("root <> most").select("x", "y", F.col("cell").alias("c"), F.col("node").alias("a"), F.col("root").alias("r"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    rest = all_.select("x", "y", F.col("cell").alias("d"), F.col("node").alias("b"), F.col("root").alias("s"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("p"))
    # between two cells only nodes of different cells meet; within them they do on their own
    met = few.join(rest, ["x", "y", "p"]).where((F.col("r") != F.col("s")) & ((F.col("x") == F.col("y")) | (F.col("c") != F.col("d"))))
    return near(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes)


def prefixes(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(node, n, token, at): the first shingles of each of the ``sets``, rare ones first, of its
    ``n``. Of two sets with a Jaccard index of ``least`` the first common shingle is among these
    in both; those of one set alone are left out, but count for the places ``at``."""
    one = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("df"))
    at = F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) - 1
    placed = one.join(shuffled(often), "token").withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-6))
    return placed.where("df > 1").select("node", "n", "token", "at")


def _can(least: float) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can have that index if their first common one has
    the places ``i`` and ``j``: all after the later place would have to be common."""
    need = F.ceil(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-6)
    return F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need


def centred(prefix: DataFrame, roots: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b): each node and, for each of its first shingles, the node of the fewest rarer ones
    there, which of a family of copies is the least edited; of different components only."""
    own = _rooted(prefix, roots)
    hub = own.groupBy("token").agg(F.min(F.struct("i", "a", "n", "r")).alias("h"))
    hub = hub.select("token", F.col("h.a").alias("b"), F.col("h.n").alias("m"), F.col("h.i").alias("j"), F.col("h.r").alias("s"))
    return _ordered(own.join(shuffled(hub), "token").where((F.col("r") != F.col("s")) & _can(least)))


def sharing(prefix: DataFrame, roots: DataFrame, least: float = 0.8, part: int = 1024) -> DataFrame:
    """(a, b): all pairs of different components that share one of their first shingles and can
    have the index ``least`` by its places. Of a shingle's nodes those outside its commonest
    component meet all, dealt in parts of about ``part`` nodes."""
    own = saved(_rooted(prefix, roots))
    tally = own.groupBy("token", "r").agg(F.count("*").alias("k"))
    tally = tally.groupBy("token").agg(F.max_by("r", F.struct("k", "r")).alias("most"), F.count("*").alias("roots"), F.sum("k").alias("k"))
    open_ = saved(tally.where("roots > 1").select("token", "most", F.ceil(F.col("k") / part).cast("int").alias("parts")))
    all_ = saved(own.join(shuffled(open_), "token"))
    few = all_.where("r <> most").select("token", "a", "n", "i", "r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    rest = all_.select("token", F.col("a").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("r").alias("s"), (F.col("r") != F.col("most")).alias("also"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("p"))
    # two nodes outside the commonest component meet once
    return _ordered(few.join(shuffled(rest), ["token", "p"]).where((F.col("r") != F.col("s")) & _can(least) & (~F.col("also") | (F.col("a") < F.col("b")))))


def _rooted(prefix: DataFrame, roots: DataFrame) -> DataFrame:
    return prefix.join(shuffled(roots), "node", "left").select("token", F.col("node").alias("a"), "n", F.col("at").alias("i"), F.coalesce("root", "node").alias("r"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that differ in at most ``MOST_DIFFERENT`` bits."""
    own = lambda name, segs: nodes.select(F.col("node").alias(name), F.col("segs").alias(segs))
    differ = sum(F.bit_count(F.get("s", i).bitwiseXOR(F.get("t", i))) for i in range(SEGMENTS))
    return pairs.join(shuffled(own("a", "s")), "a").join(shuffled(own("b", "t")), "b").where(differ <= MOST_DIFFERENT).select("a", "b")


def candidates(nodes: DataFrame, cells: tuple[DataFrame, DataFrame, DataFrame], hot: int = 4, hubs: int = 2) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, segs) of which a segment is equal or differs in one bit,
    and which differ in at most ``MOST_DIFFERENT`` bits altogether.

    Nodes of an equal segment are a cell. Cells are indexed by their one-wildcard variants; a
    variant has two cells at most, those with its bit set and not set, so a grouped minimum
    and maximum are the equality join. Cells of up to ``hot`` nodes stand for themselves; of
    larger ones ``hubs`` nodes do, which follow one order of all nodes, and each of their nodes
    meets these. So in a group of near copies pairs grow with its size, not with its square;
    ``centred`` and ``sharing`` bring the pairs of large cells that this leaves out and that can
    still count."""
    member, sizes, next_to = cells
    within = sizes.where("c = 2").select("a", "b")
    # who stands for a cell: all of a small one, the smallest of each residue of a large one
    asked = next_to.select(F.explode(F.array("x", "y")).alias("cell")).distinct()
    crowd = saved(member.join(few_or_shuffled(sizes.where("c > 2").select("cell", "c")), "cell"))
    large = crowd.where(F.col("c") > hot)
    hub = large.groupBy("cell", F.pmod("node", F.lit(hubs)).alias("part")).agg(F.min("node").alias("node")).select("cell", "node")
    ones = sizes.where("c <= 2").select("cell", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    reps = ones.join(shuffled(asked), "cell", "left_semi").union(crowd.where(F.col("c") <= hot).select("cell", "node").union(hub).join(shuffled(asked), "cell", "left_semi"))
    reps = saved(reps)
    side = lambda c, n: reps.select(F.col("cell").alias(c), F.col("node").alias(n))
    across = next_to.join(shuffled(side("x", "a")), "x").join(shuffled(side("y", "b")), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    some = crowd.where(F.col("c") <= hot)
    few = some.alias("x").join(shuffled(some).alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    stars = large.alias("x").join(shuffled(hub).alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") != F.col("y.node"))).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return near(within.union(few).union(stars).union(across).distinct(), nodes)


def verified(pairs: DataFrame, sets: DataFrame, least: float = 0.8) -> DataFrame:
    """The ``pairs`` (a, b) whose sets (node, shingles) have a Jaccard index of ``least``."""
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    return pairs.join(shuffled(a), "a").join(shuffled(b), "b").where(common >= least * (F.size("s") + F.size("t") - common) - 1e-9).select("a", "b")


def similar_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8, hot: int = 4, hubs: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two tables: the nodes (node, doc_id, text_hash: its row of the smallest id, nulls last,
    then hash of the text) and links (a, b) between different nodes whose texts are near copies:
    their components are those of all pairs of nodes in equal or neighbouring cells."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    found = stored(with_segments(rows), "segments")
    # rows of one node have the same segments: these meet here, before any join
    nodes = saved(found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m"), F.first("segs").alias("segs")))
    nodes_ = nodes.select("node", "segs")
    cells = _cells(nodes_)
    firsts = nodes.select("node", "m.doc_id", F.col("m.h").alias("text_hash"))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = saved(some.distinct().join(shuffled(firsts), "node").withColumnRenamed("doc_id", "_d"))
        own = rows.join(few_or_shuffled(wanted), (F.col("h") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("node", "text")
        return stored(with_shingles(own, shingle), "shingles").dropDuplicates(["node"])

    pairs = saved(candidates(nodes_, cells, hot, hubs))
    found = saved(verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), least))
    # what hubs left unmet counts only between components, so it is looked at once these are known
    roots = saved(components(found))
    open_, of = unmet(nodes_, roots, cells, hot)
    sets = sets_of(of.join(shuffled(open_.select(F.explode(F.array("x", "y")).alias("cell")).distinct()), "cell", "left_semi").select("node"))
    first = saved(prefixes(sets, least))
    found = saved(found.union(verified(saved(centred(first, roots, least)), sets, least)))
    return firsts, found.union(saved(verified(saved(sharing(first, saved(components(found)), least)), sets, least)))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8, hot: int = 4, hubs: int = 2) -> DataFrame:
    """``docs`` with one row of each component of near copies: that of its smallest doc_id, so
    one without an id stays only if all have none; of equal rows one stays. Null and empty
    texts and those of white space are copies of each other. Extra columns may have any names;
    an empty table gives none."""
    firsts, edges = similar_links(docs, text, doc_id, shingle, least, hot, hubs)
    roots = components(edges)
    of = firsts.join(shuffled(roots), "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    best = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m"))
    key, h = named_apart(docs, "_key", "_text_hash")
    stays = best.select(_key(F.col("m.doc_id")).alias(key), F.col("m.text_hash").alias(h))
    rows = docs.withColumn(key, _key(F.col(doc_id))).withColumn(h, F.xxhash64(F.col(text)))
    return rows.join(shuffled(stays), [key, h], "left_semi").dropDuplicates([key, h]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit(""))
