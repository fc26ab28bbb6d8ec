"""Document structure: sections, chunks, passes, figures, outlines, contexts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import reading
from paperlake.functions.text import blank, normal_item
from paperlake.operators.common import top

# fixed values: headings by section name with their default numbers, and what ends a paper
HEADINGS = [
    ("abstract", r"^\s*(abstract|摘要)\s*$", "0"),
    ("intro", r"^\s*(\d+\s*[\.\)]?\s*)?(introduction|background|引言|绪论|前言)\s*$", "1"),
    ("method", r"^\s*\d+\s*[\.\)]\s*(methods?|methodology|models?|方法|模型)\b.*$", "2"),
    ("method", r"^\s*(methods?|methodology|materials?\s+and\s+methods?)\s*$", "2"),
    ("experiments", r"^\s*\d+\s*[\.\)]\s*(experiments?|evaluations?|results?|discussions?|实验|结果|评估|讨论)\b.*$", "3"),
    ("experiments", r"^\s*(results?|discussions?|结果|讨论)\s*$", "3"),
    ("conclusion", r"^\s*(\d+\s*[\.\)]?\s*)?(conclusions?|总结|结论)\s*$", "4"),
]
TAIL = r"^\s*(references|参考文献|acknowledgements?|致谢|data availability|author contributions?|funding|declarations?|competing interests|additional information|作者贡献|利益冲突|补充信息)\s*$"
# fixed values: the share of a context that each section may have
QUOTAS = {"abstract": 0.14, "intro": 0.18, "method": 0.30, "experiments": 0.26, "conclusion": 0.12}


def sections(docs: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """(key, ord, name, sec, text, confidence, downgrade): lines are numbered, headings start
    sections by a running count over a document's lines, neighbours of one name and number
    are joined, what follows a closing heading goes. Confidence is .9 for numbered headings,
    .65 for bare ones, .5 at most under 200 characters, .55 for a long text before the first
    heading; a document with any under .5 is downgraded. Without headings a document is one
    section ``full`` of confidence 0."""
    lines = docs.select(key, F.posexplode(F.split(blank(F.col(text)), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("no", "line"))
    head = F.coalesce(*[F.when(F.trim("line").rlike(f"(?iU){p}"), F.struct(F.lit(n).alias("name"), F.coalesce(F.nullif(F.regexp_extract(F.trim("line"), r"^\s*(\d+(?:\.\d+)*)\b", 1), F.lit("")), F.lit(d)).alias("sec"))) for n, p, d in HEADINGS])
    doc, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("no")
    rows = lines.withColumn("head", head).withColumn("tail", F.min(F.when(F.trim("line").rlike(f"(?i){TAIL}"), F.col("no"))).over(doc))
    rows = rows.withColumn("part", F.count("head").over(so_far.rowsBetween(Window.unboundedPreceding, 0))).withColumn("heads", F.count("head").over(doc))
    rows = rows.where((F.col("heads") == 0) | F.col("tail").isNull() | (F.col("no") < F.col("tail")) | (F.col("part") == 0))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n")
    parts = rows.groupBy(key, "part").agg(F.max("heads").alias("heads"), F.max("head").alias("head"), F.min_by("line", "no").alias("first"), joined().alias("body"), F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda s: (F.length(F.trim(s["line"])) > 60) | F.trim(s["line"]).rlike("[。．.!?]$")), lambda s: s["line"]), "\n").alias("prose"))
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    whole, before = F.col("heads") == 0, (F.col("heads") > 0) & (F.col("part") == 0)
    conf = F.when(whole, 0.0).when(before, 0.55).otherwise(F.when(F.col("first").rlike(r"^\s*\d+"), 0.9).otherwise(0.65))
    conf = F.when(~whole & ~before & (F.length(body) < 200), F.least(conf, F.lit(0.5))).otherwise(conf)
    parts = parts.where(~before | (F.length(F.trim("prose")) > 400)).select(key, "part", F.when(whole, "full").when(before, "intro").otherwise(F.col("head.name")).alias("name"), F.when(whole, "0").when(before, "1").otherwise(F.col("head.sec")).alias("sec"), F.when(before, F.trim("prose")).otherwise(body).alias("text"), conf.alias("confidence"))
    by = Window.partitionBy(key).orderBy("part")
    fresh = ~(F.lag("name").over(by).eqNullSafe(F.col("name")) & F.lag("sec").over(by).eqNullSafe(F.col("sec")))
    parts = parts.withColumn("ord", F.sum(fresh.cast("int")).over(by))
    merged = parts.groupBy(key, "ord").agg(F.min_by(F.struct("name", "sec", "confidence"), "part").alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return merged.select(key, "ord", "h.name", "h.sec", "text", "h.confidence", (F.min("h.confidence").over(doc) < 0.5).alias("downgrade"))


# fixed values: what no cut may go through, what ends no sentence
PROTECTED = [re.compile(p, re.M) for p in (r"(?:(?<=\n)|^)[ \t]*\|[^\n]+\|[ \t]*\r?\n[ \t]*\|[-:\s|]+\|[ \t]*\r?\n(?:[ \t]*\|[^\n]+\|[ \t]*\r?\n?)*", r"\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]", r"(?<!\\)\$(?:\\\$|[^\$\n])+\$|\\\([\s\S]*?\\\)", r"```[\s\S]*?```")]
ABBREVIATED = re.compile(r"\b(?:e\.g|i\.e|Fig|Tab|Sec|Eq|Eqs|vs|al|No|Figs|Tabs|ref|Ref|Dr|Prof|pp|vol|dept|univ)\.\s*$", re.I)
# fixed values, from coarse to fine: headings, paragraphs, sentences, clauses
LEVELS = [(re.compile(p), sentence) for p, sentence in ((r"\n\n+(?=#{1,4}\s|\d+\.\d+\s+[A-Za-z一-鿿])", False), (r"\n\n+", False), (r"(?<=[。！？\?!])\s*|(?<=\.)(?!\d)\s+", True), (r"(?<=[；;])\s*", False))]


def units(text: str, most: int = 1200) -> Iterator[str]:
    """Smallest pieces that chunks are made of; tables, formulas and code stay whole."""

    def cut(piece: str, level: int) -> Iterator[str]:
        if level == len(LEVELS) or (level and len(piece) <= most):
            if piece.strip():
                yield piece.strip()
            return
        pattern, sentence = LEVELS[level]
        held = [(m.start(), m.end()) for p in PROTECTED for m in p.finditer(piece)]
        start = 0
        for m in pattern.finditer(piece):
            at = m.end()
            if any(a < at < b for a, b in held) or (sentence and ABBREVIATED.search(piece[max(0, at - 24) : at])):
                continue
            yield from cut(piece[start:at].strip(), level + 1)
            start = at
        yield from cut(piece[start:].strip(), level + 1)

    return cut(text.strip(), 0)


def packed(text: str | None, target: int = 1100, overlap: int = 120, most: int = 1200) -> list[str]:
    """Chunks of up to ``most`` characters; each repeats the last units of the one before, up
    to ``overlap`` characters. A longer unit is a chunk of its own.

    A chunk is a range of units. With the lengths of units and of what joins them summed up,
    its end is looked up: the first that reaches ``target``, or the last within ``most``, but
    one new unit at least. The next one begins with the last unit that leaves ``overlap``
    characters, but never where this one did."""
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    parts = list(units(text, most))
    ends = np.cumsum([0, *map(len, parts)])
    joined = ends + 2 * np.arange(len(ends))
    bounds, begin, new = [], 0, 0
    while new < len(parts):
        if begin == new and len(parts[new]) > most:
            stop = after = new + 1
        else:
            full = np.searchsorted(joined, joined[begin] + 2 + target)
            room = np.searchsorted(joined, joined[begin] + 2 + most, "right") - 1
            stop = int(min(len(parts), max(new + 1, min(full, room))))
            after = int(min(stop, max(begin + 1, np.searchsorted(ends, ends[stop] - overlap, "right") - 1)))
        bounds.append((begin, stop))
        begin, new = after, stop
    out = ["\n\n".join(parts[a:b]) for a, b in bounds]
    return out[:-1] if len(out) > 1 and out[-1] == out[-2] else out


def chunks(parts: DataFrame, key: str = "paper_id", sec: str = "sec", text: str = "text", target: int = 1100, overlap: int = 120, most: int = 1200) -> DataFrame:
    """(key, sec, chunk_no, chunk_id, text). Packing is a sequential fold over a text, so it
    runs in an Arrow-batched pandas function; rows are independent of each other."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(t, target, overlap, most))

    rows = parts.select(key, sec, F.posexplode(pack(F.col(text))).alias("n", "text"))
    return rows.select(key, sec, (F.col("n") + 1).alias("chunk_no"), F.concat(F.col(key).cast("string"), F.lit("_Sec"), F.col(sec).cast("string"), F.lit("_C"), F.lpad((F.col("n") + 1).cast("string"), 3, "0")).alias("chunk_id"), "text")


def extractive(docs: DataFrame, key: str, text: str = "text", most: int = 500, must_have: Column | None = None) -> DataFrame:
    """(key, summary), a row for each of ``docs``: see ``reading.extract``."""
    return docs.select(key, reading.extract(F.col(text), most, must_have).alias("summary"))


def figure_references(parts: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """(key, sec, item, n) of figures and tables named in sections."""
    found = F.regexp_extract_all(blank(F.col(text)), F.lit(r"(?i)(?:\bfig(?:ure)?s?\.?|图|\btab(?:le)?s?\.?|表)\s*\d+"), F.lit(0))
    return parts.select(key, "sec", F.explode(F.transform(found, lambda m: normal_item(F.regexp_replace(m, r"\.", " ")))).alias("item")).groupBy(key, "sec", "item").agg(F.count("*").alias("n"))


def figure_hosts(references: DataFrame, order: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, item, secs, host): all sections that name an item, and the last one of them."""
    rows = references.join(order.select(key, "sec", "ord"), [key, "sec"])
    return rows.groupBy(key, "item").agg(F.array_sort(F.collect_set("sec")).alias("secs"), F.max_by("sec", "ord").alias("host"))


def passes(parts: DataFrame, key: str = "paper_id", limits: tuple[int, int, int] = (7500, 10500, 12000)) -> DataFrame:
    """(key, pass1, pass2, pass3, coverage): the inputs of the reading passes; downgraded
    papers have the first alone."""
    body = lambda names: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isin(names), F.struct("ord", "text")))), lambda s: s["text"]), "\n\n")
    groups = (["abstract", "intro", "conclusion", "full"], ["method"], ["experiments"])
    rows = parts.groupBy(key).agg(F.bool_or("downgrade").alias("down"), F.sum(F.length("text")).alias("n"), *[F.left(body(g), F.lit(m)).alias(f"pass{i + 1}") for i, (g, m) in enumerate(zip(groups, limits))])
    empty = lambda c: F.when(F.col("down"), F.lit("")).otherwise(F.col(c)).alias(c)
    rows = rows.select(key, "n", "pass1", empty("pass2"), empty("pass3"))
    return rows.select(key, "pass1", "pass2", "pass3", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.length("pass1") + F.length("pass2") + F.length("pass3"), "n"), F.lit(1.0))).alias("coverage"))


def context_fit(sentences: DataFrame, budget: int = 9000, key: str = "paper_id") -> DataFrame:
    """Sentences (key, name, pos, sentence, overlap) that fit: every section name has its quota
    of ``budget`` characters, renormalised over the names there are; sentences with the most
    overlap come first, then by position; the first that does not fit ends its section."""
    quota = F.coalesce(*[F.when(F.col("name") == n, F.lit(q)) for n, q in QUOTAS.items()], F.lit(0.12))
    names = sentences.select(key, "name").distinct().withColumn("q", quota)
    names = names.withColumn("room", F.floor(budget * F.col("q") / F.sum("q").over(Window.partitionBy(key))))
    by = Window.partitionBy(key, "name").orderBy(F.desc("overlap"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = sentences.withColumn("upto", F.sum(F.length("sentence") + 1).over(by)).join(names.select(key, "name", "room"), [key, "name"])
    return rows.where(F.col("upto") - 1 <= F.col("room")).drop("upto", "room")


def even_groups(rows: DataFrame, key: str, order: str, groups: int = 3) -> DataFrame:
    return rows.withColumn("group", F.ntile(groups).over(Window.partitionBy(key).orderBy(order)))


FORMULA = r"(?s)\$\$.+?\$\$|\\begin\{equation\*?\}.+?\\end\{equation\*?\}|(?<![\\$])\$[^$\n]+\$(?!\$)"


def tex_of(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"^\$\$?|\$\$?$|\\(?:begin|end)\{equation\*?\}", ""))


def formulas(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, no, tex, display) of $$..$$, $..$ and equation environments."""
    found = F.regexp_extract_all(blank(F.col(text)), F.lit(FORMULA), F.lit(0))
    rows = docs.select(key, F.posexplode(found).alias("no", "raw"))
    display = ~F.col("raw").rlike(r"^\$[^$]")
    return rows.select(key, "no", tex_of(F.col("raw")).alias("tex"), display.alias("display"))


