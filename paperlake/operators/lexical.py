"""Lexical index and ranking: TF-IDF, BM25, pair scores, confidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.text import expanded, raw_tokens, tokens
from paperlake.operators import impact
from paperlake.operators.common import kept, small

#: Terms up to so many are broadcast to their postings.
BROADCAST_TERMS = 500_000


def postings(docs: DataFrame, key: str, text: str = "text", words=raw_tokens) -> DataFrame:
    """(key, term, tf): the words of a text, lower-cased, counted where the text is, without a
    shuffle; rows that share a key, if there are any, are added up after."""
    rows = docs.select(key, F.transform(words(F.col(text)), F.lower).alias("terms"))
    kind = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    counts = rows.mapInArrow(_counted, kind)
    once = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return counts if once else counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def _counted(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(key, term, tf) of batches (key, terms), some rows of about ``most`` words at a time."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            terms = batch.column(1).slice(low, high - low).flatten().dictionary_encode()
            if not len(terms):
                continue
            n = len(terms.dictionary)
            rows = np.repeat(np.arange(low, high), sizes[low:high])
            of, tf = np.unique(rows * n + np.asarray(terms.indices, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of // n)), terms.dictionary.take(pa.array(of % n)), pa.array(tf.astype(np.int64))], [batch.schema.names[0], "term", "tf"])


def idf_table(posts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((n + 1) / (df + 1)) + 1; ``n_docs`` has one row (n)."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted(posts: DataFrame, idf: DataFrame, default: Column | None = None) -> DataFrame:
    """Adds w = (1 + ln tf) * idf; terms without idf count with ``default`` (else they go)."""
    joined = posts.join(idf.select("term", "idf"), "term", "inner" if default is None else "left")
    value = F.col("idf") if default is None else F.coalesce("idf", default)
    return joined.withColumn("w", (1 + F.ln("tf")) * value).drop("idf")


def norms(weights: DataFrame, key: str) -> DataFrame:
    n = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return n.withColumn("norm", F.when(F.col("norm") == 0, F.lit(1.0)).otherwise(F.col("norm")))


@dataclass
class Index:
    """Postings (key, term, tf) and idf (term, df, idf) in the shared folder. ``terms``: how
    many different ones there are; up to ``BROADCAST_TERMS`` go to the postings."""

    key: str
    posts: DataFrame
    idf: DataFrame
    terms: int
    documents: int

    def idf_near(self) -> DataFrame:
        return F.broadcast(self.idf) if self.terms <= BROADCAST_TERMS else self.idf


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", words=raw_tokens) -> Index:
    """Reads the texts once; all rankings over one index share it."""
    posts = kept(postings(docs, key, text, words), "postings")
    idf = kept(idf_table(posts, docs.agg(F.count("*").alias("n"))), "idf")
    return Index(key, posts, idf, idf.count(), docs.count())


def cosine_impacts(at: Index, only: DataFrame | None = None) -> impact.Impacts:
    """Postings with their share in the document's unit vector; ``only`` (term): of these."""
    w = weighted(at.posts, at.idf_near())
    norm = kept(norms(w, at.key), "norms")
    rows = w.join(at.idf_near().select("term", "df"), "term").join(small(norm), at.key)
    return impact.stored_impacts(rows.withColumn("x", F.col("w") / F.col("norm")), at.key, at.documents, "s", only)


def tfidf_topk(docs: DataFrame, queries: DataFrame, k: int = 3, doc: str = "doc_id", query: str = "item_id", at: Index | None = None) -> DataFrame:
    """(query, rank, doc, score_micro): the k documents of the highest cosine. Documents that
    share no term with a query score 0 and are not listed. ``at``: the documents' index, if
    there is one."""
    at = at or index(docs, doc)
    asked = postings(queries, query).join(at.idf.select("term", "idf"), "term", "left")
    asked = asked.select(query, "term", ((1 + F.ln("tf")) * F.coalesce("idf", F.ln(F.lit(2.0)) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(query)))
    asked = asked.select(query, "term", (F.col("w") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).alias("qw"))
    asked = kept(asked, "queries")
    return impact.topk(cosine_impacts(at, asked.select("term").distinct()), asked, k, query)


def bm25_impacts(docs: DataFrame, doc: str = "doc_id", k1: float = 1.2, b: float = 0.75, only: DataFrame | None = None) -> impact.Impacts:
    """Postings of index tokens with what they add to a score; n and the mean length are those
    of all documents; an idf under 1e-6 is 1e-6. ``only`` (term): of these terms."""
    posts = kept(postings(docs, doc, words=expanded), "postings")
    n = docs.count()
    mean = (posts.agg(F.sum("tf")).first()[0] or 0) / max(1, n)
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    df = kept(df.select("term", "df", F.greatest(F.lit(1e-6), F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf")), "idf")
    near = F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    lengths = kept(posts.groupBy(doc).agg(F.sum("tf").alias("len")), "lengths")
    rows = posts.join(near, "term").join(small(lengths), doc)
    x = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
    return impact.stored_impacts(rows.withColumn("x", x), doc, n, "x", only)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", query: str = "item_id", most_terms: int | None = 24, at: impact.Impacts | None = None) -> DataFrame:
    """(query, rank, doc, score_micro). Terms are index tokens; a query is its first
    ``most_terms`` of them, all if that is None, repeats counted once. ``at``: the documents'
    impacts, if there are any."""
    terms = expanded(F.col("text"))
    low = F.array_distinct(F.transform(terms if most_terms is None else F.slice(terms, 1, most_terms), F.lower))
    asked = kept(queries.select(query, F.explode(low).alias("term"), F.lit(1.0).alias("qw")), "queries")
    at = at or bm25_impacts(docs, doc, only=asked.select("term").distinct())
    return impact.topk(at, asked, k, query)


def _pair_terms(pairs: DataFrame, claim: str, source: str) -> DataFrame:
    """(pair_id, term, ctf, stf): counts in claim and source, null where a side lacks a term."""
    c = pairs.select("pair_id", F.explode(tokens(F.col(claim))).alias("term")).groupBy("pair_id", "term").agg(F.count("*").alias("ctf"))
    s = pairs.select("pair_id", F.explode(tokens(F.col(source))).alias("term")).groupBy("pair_id", "term").agg(F.count("*").alias("stf"))
    return c.join(s, ["pair_id", "term"], "full")


def pair_scores(pairs: DataFrame, claim: str = "claim", source: str = "source") -> DataFrame:
    """Adds ``score`` to pairs (pair_id, claim, source): .65 of their cosine and .35 of the share
    of the claim's words that the source has. The source is the only document, so idf is 1
    for its words and ln 2 + 1 for others. A claim without words scores 0."""
    both = F.col("ctf").isNotNull() & F.col("stf").isNotNull()
    cw = F.when(F.col("ctf").isNotNull(), (1 + F.ln("ctf")) * F.when(F.col("stf").isNotNull(), F.lit(1.0)).otherwise(F.ln(F.lit(2.0)) + 1)).otherwise(0.0)
    sw = F.when(F.col("stf").isNotNull(), 1 + F.ln("stf")).otherwise(0.0)
    sums = _pair_terms(pairs, claim, source).groupBy("pair_id").agg(F.sum(cw * sw).alias("dot"), F.sqrt(F.sum(cw * cw)).alias("cn"), F.sqrt(F.sum(sw * sw)).alias("sn"), F.count_if(both).alias("found"), F.count("ctf").alias("words"))
    value = 0.65 * F.coalesce(F.try_divide("dot", F.col("cn") * F.col("sn")), F.lit(0.0)) + 0.35 * F.coalesce(F.try_divide("found", "words"), F.lit(0.0))
    return pairs.join(sums.select("pair_id", F.least(F.lit(1.0), value).alias("score")), "pair_id", "left").fillna(0.0, ["score"])


def blend_scores(pairs: DataFrame, idf: DataFrame, claim: str = "claim", source: str = "source") -> DataFrame:
    """Adds ``blend``: .25 of the cosine under corpus idf and .75 of the idf-weighted share of
    the claim's words found; times .7 under six different words; 1 at most. Unseen words
    weigh ln 2 + 1 in the cosine and 1 in the share. Pairs are told apart by ``pair_id``."""
    other = F.ln(F.lit(2.0)) + 1
    t = _pair_terms(pairs, claim, source).join(idf.select("term", "idf"), "term", "left")
    cw = F.when(F.col("ctf").isNotNull(), (1 + F.ln("ctf")) * F.coalesce("idf", other)).otherwise(0.0)
    sw = F.when(F.col("stf").isNotNull(), (1 + F.ln("stf")) * F.coalesce("idf", other)).otherwise(0.0)
    share = F.coalesce("idf", F.lit(1.0))
    sums = t.groupBy("pair_id").agg(F.sum(cw * sw).alias("dot"), F.sqrt(F.sum(cw * cw)).alias("cn"), F.sqrt(F.sum(sw * sw)).alias("sn"), F.sum(F.when(F.col("ctf").isNotNull() & F.col("stf").isNotNull(), share).otherwise(0.0)).alias("found"), F.sum(F.when(F.col("ctf").isNotNull(), share).otherwise(0.0)).alias("asked"), F.count("ctf").alias("words"))
    value = 0.25 * F.coalesce(F.try_divide("dot", F.col("cn") * F.col("sn")), F.lit(0.0)) + 0.75 * F.coalesce(F.try_divide("found", "asked"), F.lit(0.0))
    value = F.when(F.col("words") < 6, value * 0.7).otherwise(value)
    return pairs.join(sums.select("pair_id", F.least(F.lit(1.0), value).alias("blend")), "pair_id", "left").fillna(0.0, ["blend"])


def confidence(query: Column, contents: Column) -> Column:
    """The share of the query's first 12 words of two characters or more (repeats counted) that
    occur in the joined contents of the highest hits."""
    words = F.slice(F.filter(tokens(query), lambda t: F.length(t) >= 2), 1, 12)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda t: F.contains(F.lower(contents), t))) / F.size(words))


def trust(conf: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (conf - 0.6) / 0.4))
