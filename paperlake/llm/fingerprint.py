"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a run of characters between line feeds that has a word) is hashed to a wide
vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a
power of two. So it does not depend on their order, repeats count, and a paragraph is added
to or taken from a document by adding or subtracting its vector (``combine``).

Lanes 0 to 15 are the halves of eight XXH64 of the paragraph's SHA-512, added modulo 2^32:
equal multisets of paragraphs have equal lanes, others differ but for collisions. Lanes 16 to
143 are the sum over the paragraph's different pairs of neighbouring words (split at blanks;
the last word stands alone) of +1 or -1 by the bits of two XXH64 of the pair, added modulo
2^16: the cosine of these lanes estimates that of the two documents' pair counts, which is the
likeness. Its standard error is about ``(1 - cosine ** 2) / 11``; counts of pairs beyond 32,767
in one direction wrap around. So that texts without blanks and short ones are seen too, words
of over ``LONG`` characters are cut into pieces of two, and so is, blanks and all, a text of up
to ``BRIEF`` characters (up to ``TINY``: of one); pieces pair like words.
A paragraph's pairs count once, but those of one that mostly repeats at most ``FEW`` pairs
count by the root of their repeats, so that the norm follows the length.

A document and its edited text share their first paragraphs, which are summed once.

Everything is DataFrame operations. Ids must be whole numbers. Null texts count as empty; the fingerprint of a text
without a word is zero, its likeness is 1 to an equal one and 0 to others. Extra columns of a
table, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import stored, whole_numbers

EXACT, GRADED = 16, 128
LONG, BRIEF, TINY, FEW = 16, 96, 32, 64
#: Buckets of the chain of rows: so many at most, of about so many rows each.
MOST_BUCKETS, ROWS_IN_BUCKET = 1 << 16, 64
#: Rows of one repeated id, or of none, are dealt over so many buckets by their hash.
SPREAD = 64


def pieces(c: Column, size: Column | int) -> Column:
    """``c`` in pieces of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), size), lambda i: F.substring(c, i, size))


def sums_of(texts: DataFrame, key: list[str], text: str, length: Column | None = None) -> DataFrame:
    """(key..., e, g): the lanes of each row's text, as 32- and 16-bit numbers. ``key`` tells
    rows apart. If ``texts`` are partitioned by a part of ``key`` nothing is shuffled.
    ``length``: that of the text of which these are paragraphs, if not of these alone."""
    whole = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.split(whole, "\n"), lambda p: F.trim(p) != "")
    parts = texts.select(*key, (F.length(whole) if length is None else length).alias("_n"), F.explode_outer(paragraphs).alias("_p"))
    words = F.array_remove(F.split("_p", " "), "")
    cut = F.flatten(F.transform("_w", lambda w: F.when(F.length(w) > LONG, pieces(w, 2)).otherwise(F.array(w))))
    parts = parts.select(*key, "_n", "_p", words.alias("_w")).withColumn("_w", F.when(F.col("_p").isNull(), None).when(F.col("_n") <= BRIEF, pieces(F.col("_p"), F.when(F.col("_n") <= TINY, 1).otherwise(2))).when(F.exists("_w", lambda w: F.length(w) > LONG), cut).otherwise(F.col("_w")))
    parts = parts.select(*key, F.sha2("_p", 512).alias("_d"), "_w")
    # pairs of neighbours; the last word of a paragraph stands alone
    pairs = F.zip_with("_w", F.slice("_w", F.lit(2), F.size("_w")), lambda x, y: F.xxhash64(x, y))
    parts = parts.select(*key, *[F.xxhash64(F.lit(j), "_d").alias(f"_h{j}") for j in range(EXACT // 2)], pairs.alias("_all")).withColumn("_w", F.array_distinct("_all"))
    often = (F.size("_w") <= FEW) & (2 * F.size("_w") <= F.size("_all"))
    by_root = F.flatten(F.transform("_w", lambda u: F.array_repeat(u, F.round(F.sqrt(F.size(F.filter("_all", lambda x: x == u)))).cast("int"))))
    parts = parts.withColumn("_w", F.when(often, by_root).otherwise(F.col("_w"))).drop("_all")
    units = parts.select(*key, *[f"_h{j}" for j in range(EXACT // 2)], F.posexplode_outer("_w").alias("_at", "_u0"))
    units = units.withColumn("_u1", F.when(F.col("_u0").isNotNull(), F.xxhash64(F.lit(1), "_u0")))
    low = F.lit(0xFFFFFFFF).cast("long")
    # a paragraph's own lanes count with its first pair
    first = lambda x: F.sum(F.when(F.col("_at") == 0, x))
    exact = [first(x) for j in range(EXACT // 2) for x in (F.col(f"_h{j}").bitwiseAND(low), F.shiftrightunsigned(f"_h{j}", 32))]
    # two counts of 32 bits to a sum: bits i and i + 32 of all hashes
    both = F.lit((1 << 32) | 1).cast("long")
    half = GRADED // 4
    graded = [F.sum(F.shiftrightunsigned(f"_u{k}", i).bitwiseAND(both)) for k in (0, 1) for i in range(half)]
    found = units.groupBy(*key).agg(F.count("_u0").alias("_n"), *[x.alias(f"_e{j}") for j, x in enumerate(exact)], *[x.alias(f"_g{j}") for j, x in enumerate(graded)])
    wrapped = lambda x, bits, kind: F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x).cast(kind)
    number = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    e = [wrapped(F.pmod(number(F.col(f"_e{j}")), F.lit(1 << 32)), 32, "int") for j in range(EXACT)]
    ones = [x for k in (0, 1) for x in [F.col(f"_g{k * half + i}").bitwiseAND(low) for i in range(half)] + [F.shiftrightunsigned(f"_g{k * half + i}", 32) for i in range(half)]]
    g = [wrapped(F.pmod(number(2 * c - F.col("_n")), F.lit(1 << 16)), 16, "smallint") for c in ones]
    return found.select(*key, F.array(*e).alias("e"), F.array(*g).alias("g"))


def of_texts(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., lanes): the fingerprint of each row's text; rows are told apart by ``key``."""
    return sums_of(rows, key, text).select(*key, unpacked(F.col("e"), F.col("g")).alias("lanes"))


def unpacked(e: Column, g: Column) -> Column:
    whole = lambda part, bits: F.transform(part, lambda x: F.pmod(x.cast("long"), F.lit(1 << bits)))
    return F.concat(whole(e, 32), whole(g, 16))


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), EXACT + GRADED)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a document of which the paragraphs of ``b`` are added to (or, with sign -1,
    taken from) those of ``a``."""
    modulus = F.transform(F.sequence(F.lit(0), F.lit(EXACT + GRADED - 1)), lambda i: F.when(i < EXACT, F.lit(1 << 32)).otherwise(F.lit(1 << 16)))
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + sign * y), modulus, lambda x, m: F.pmod(x, m))


def text_of(lanes: Column) -> Column:
    """Hexadecimal: 8 digits for each exact lane, then 4 for each graded one."""
    hexed = lambda part, n: F.array_join(F.transform(part, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(hexed(F.slice(lanes, 1, EXACT), 8), hexed(F.slice(lanes, EXACT + 1, GRADED), 4))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the graded lanes, read as signed numbers; 1 for equal lanes."""
    signed = lambda x: F.transform(F.slice(x, EXACT + 1, GRADED), lambda v: F.when(v >= 1 << 15, v - (1 << 16)).otherwise(v).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = signed(a), signed(b)
    norms = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norms > 0, dot(x, y) / norms).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in descending order of doc_id (then of text hash and text, null ids last), as
    (bucket, guest, rn, doc_id, text, next_text); after the last row comes the first. Buckets
    are ranges of ids by quantiles, highest first; a repeated id that fills whole ranges, and
    null ids, are cut further by the hash of the text. Each bucket ends with the first row of
    the one after it as a guest, so no task needs more than one bucket. Rows are partitioned
    by ``bucket`` and texts are shuffled once."""
    whole_numbers(docs, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    side = max(1, int(min(MOST_BUCKETS, rows.count() // ROWS_IN_BUCKET) ** 0.5))
    n = side * side
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    found, repeated = F.lit(0), []
    if cuts:
        repeated = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
        groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
        # how many cuts are at or below the id, looked up in two steps
        below = lambda part: F.size(F.filter(part, lambda c: c <= F.col("doc_id")))
        block = F.greatest(below(F.lit([g[0] for g in groups])) - 1, F.lit(0))
        found = block * side + below(F.get(F.lit(groups), block))
    rows = rows.withColumn("h", F.xxhash64("text"))
    by_hash = F.shiftright("h", 58).cast("int") + SPREAD // 2
    # a repeated id is the smallest of its range: its rows come after the others there
    part = F.when(F.col("doc_id").isNull(), by_hash - SPREAD)
    if repeated:
        part = part.when(F.col("doc_id").isin(repeated), found * (SPREAD + 1) + by_hash)
    rows = rows.withColumn("bucket", part.otherwise(found * (SPREAD + 1) + SPREAD))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()]
    # at most a row for each bucket, whatever the input: ids first, then their texts
    heads = F.broadcast(rows.groupBy(F.col("bucket").alias("b")).agg(F.max("doc_id").alias("head")))
    firsts = rows.join(heads, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head"))).select("bucket", "doc_id", "text", "h")
    firsts = stored(firsts.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where("k = 1").drop("k"), "firsts")
    chain = sorted((r["bucket"] for r in firsts.select("bucket").collect()), reverse=True)
    before = docs.sparkSession.createDataFrame([(b, chain[i - 1]) for i, b in enumerate(chain)], "own int, bucket int")
    guests = firsts.withColumnRenamed("bucket", "own").join(F.broadcast(before), "own").select("doc_id", "text", "h", "bucket", F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    w = Window.partitionBy("bucket").orderBy("guest", *order)
    return both.select("bucket", "guest", F.row_number().over(w).alias("rn"), "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has its last third (whole code
    points, rounded down) replaced by as many of the first ones of the next document. A table
    of one row is its own next one; an empty table gives no rows; of rows of one id, equal ones
    are interchangeable.

    One shuffle brings each text beside the next one; sums, comparisons and the result follow
    in the same stage, so nothing else is written."""
    rows = numbered(docs, doc_id, text)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited).otherwise(F.lit("")))
    # the characters up to the last line feed of what stays; short texts are cut by their length
    stays = F.left("text", n - third)
    shared = F.when(F.least(n, F.length("edited")) > BRIEF, F.length(stays) - F.length(F.substring_index(stays, "\n", -1))).otherwise(0)
    # the digest goes through the sums as four numbers, which make a narrow key
    sha = [F.conv(F.substring(F.sha2("edited", 256), 16 * i + 1, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    key = ["bucket", "rn", "guest", "doc_id", "n_chars", "s0", "s1", "s2", "s3", "which"]
    rest = lambda c: F.substring(F.col(c), F.col("shared") + 1, F.greatest(F.length(c), F.lit(1)))
    rows = rows.withColumn("shared", shared).select("bucket", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), *sha, F.length("edited").alias("_edited"), F.array(F.left("text", F.col("shared")), rest("text"), rest("edited")).alias("texts"))
    rows = rows.select(*key[:-1], "_edited", F.posexplode_outer("texts").alias("which", "text"))
    w = Window.partitionBy("bucket").orderBy("rn", "which")
    own = F.when(F.col("which") == 2, F.col("_edited")).otherwise(F.col("n_chars"))
    lanes = sums_of(rows, key, "text", own).withColumn("v", F.struct("e", "g"))
    # in order: what is shared, the rest of the text, that of the edited text; the next document's
    out = lanes.select(*key, F.col("v").alias("v0"), *[F.lead("v", i).over(w).alias(f"v{i}") for i in range(1, 5)]).where((F.col("which") == 0) & ~F.col("guest"))
    digest = F.lower(F.concat(*[F.lpad(F.hex(f"s{i}"), 16, "0") for i in range(4)]))
    out = out.select("doc_id", "n_chars", digest.alias("edited_sha256"), *[unpacked(F.col(f"v{i}.e"), F.col(f"v{i}.g")).alias(f"v{i}") for i in range(5)])
    out = out.select("doc_id", "n_chars", "edited_sha256", *[combine(F.col(f"v{i}"), F.col(f"v{j}")).alias(x) for x, i, j in (("a", 0, 1), ("b", 0, 2), ("c", 3, 4))])
    return out.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"), text_of(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
