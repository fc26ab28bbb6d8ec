"""Text column functions: cleaning, tokens, keywords, terms, citations, sections, hashes.

All are JVM-side expressions; null texts count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
TOKEN = rf"[A-Za-z0-9{CJK}]+(?:[-_][A-Za-z0-9{CJK}]+)*"

# fixed values: words that are no keywords, in any case
STOP = ["the", "a", "an", "of", "and", "or", "is", "are", "was", "were", "be", "to", "in", "on", "for", "with", "as", "by", "we", "our", "this", "that", "these", "those", "it", "at", "from", "using", "based", "can", "not", "no", "such", "which", "than", "then", "also", "into", "over", "under", "between", "的", "了", "和", "与", "及", "中", "对", "为", "在", "是", "等", "通过", "进行", "本文", "我们", "该", "这", "其", "被", "而", "以", "并", "或"]
KEYWORD_STOP = ["evaluation", "metric", "metrics", "algorithm", "model", "models", "dataset", "datasets", "benchmark", "benchmarks", "theoretical", "component", "components", "problem", "problems", "task", "tasks", "limitation", "limitations", "artifact", "method", "methods", "approach", "result", "results", "paper", "figure", "table", "study", "data", "analysis", "performance", "accuracy", "baseline"]
# fixed values: ligatures and signs, and what stands for them
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "…": "..."}
SIGNS = {"‘": "'", "’": "'", "“": '"', "”": '"', " ": " ", "​": "", "﻿": "", "�": ""}
# fixed values: abbreviations of which the full stop ends no sentence
ABBREVIATIONS = ["e.g", "i.e", "Fig", "Tab", "Sec", "Eq", "Eqs", "vs", "al", "No", "Figs", "Tabs"]
POINT, ABBREVIATED = "", ""


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def sanitize(c: Column) -> Column:
    """Ligatures, quotes, invisible and control characters, long runs of blanks and lines."""
    for sign, plain in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    one = [s for s in SIGNS if SIGNS[s]]
    c = F.translate(c, "".join(one) + "".join(s for s in SIGNS if not SIGNS[s]), "".join(SIGNS[s] for s in one))
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{4,}", "  ")


def clean(c: Column) -> Column:
    """Note text without control and replacement characters, trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f�]", ""), r"^(?U)\s+|(?U)\s+$", "")


def protect(c: Column) -> Column:
    """Points of decimals and abbreviations as single marks; the length stays the same."""
    c = F.regexp_replace(c, r"(?<=\d)\.(?=\d)", POINT)
    for word in ABBREVIATIONS:
        letters = word.split(".")
        pattern = r"(?iU)\b" + "".join(rf"({x})\." for x in letters)
        c = F.regexp_replace(c, pattern, "".join(f"${k}{ABBREVIATED}" for k in range(1, len(letters) + 1)))
    return c


def restore(c: Column) -> Column:
    return F.translate(c, POINT + ABBREVIATED, "..")


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(protect(blank(c)), F.lit(r"(?s)(?:.*?(?:[。！？!?]|\.(?=(?U)\s|\z)))|.+\z"), F.lit(0))


def _sentence(piece: Column) -> Column:
    return F.regexp_replace(restore(piece), r"^(?U)\s+|(?U)\s+$", "")


def sentences(c: Column) -> Column:
    """ARRAY<STRING> of the sentences, trimmed, empty ones left out."""
    return F.filter(F.transform(_pieces(c), _sentence), lambda s: s != "")


def sentence_spans(c: Column) -> Column:
    """ARRAY<STRUCT<sentence, start, end>>: offsets (from 0) are exact in ``c``. One fold over
    the pieces, so they are found once."""
    none = F.array().cast("array<struct<sentence:string,start:int,end:int>>")

    def step(held: Column, piece: Column) -> Column:
        upto = held["n"] + F.length(piece)
        return F.struct(upto.alias("n"), F.array_append(held["spans"], F.struct(_sentence(piece).alias("sentence"), held["n"].alias("start"), upto.alias("end"))).alias("spans"))

    spans = F.aggregate(_pieces(c), F.struct(F.lit(0).alias("n"), none.alias("spans")), step, lambda held: held["spans"])
    return F.filter(spans, lambda s: s["sentence"] != "")


def raw_tokens(c: Column) -> Column:
    """Runs of letters, digits and CJK characters, joined by - or _."""
    return F.regexp_extract_all(blank(c), F.lit(TOKEN), F.lit(0))


def tokens(c: Column) -> Column:
    """The same, lower-cased."""
    return F.transform(raw_tokens(c), F.lower)


def cjk_pairs(c: Column) -> Column:
    runs = F.regexp_extract_all(blank(c), F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def expanded(c: Column) -> Column:
    """Index tokens: words of two letters or more, numbers, CJK pairs, CJK characters."""
    words = F.regexp_extract_all(blank(c), F.lit(r"[A-Za-z][A-Za-z\-]{1,}|\d+(?:\.\d+)?"), F.lit(0))
    singles = F.regexp_extract_all(blank(c), F.lit(f"[{CJK}]"), F.lit(0))
    return F.concat(words, cjk_pairs(c), singles)


def keyword_tokens(c: Column) -> Column:
    """Candidates for keywords, repeats kept, without stop words."""
    words = F.regexp_extract_all(blank(c), F.lit(r"[A-Za-z][A-Za-z\-]{2,}|\d+(?:\.\d+)?"), F.lit(0))
    stop = F.lit([*STOP, *KEYWORD_STOP])
    return F.filter(F.concat(words, cjk_pairs(c)), lambda w: ~F.array_contains(stop, F.lower(w)))


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+"), F.lit(0)), cjk_pairs(c)))


def lexical_similarity(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))


def dedup_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "")


def mentions(text: Column, term: Column) -> Column:
    """Whether ``term`` stands in ``text`` in any case: by itself for ASCII terms, anywhere for
    terms with CJK characters."""
    low, name = F.lower(blank(text)), F.lower(term)
    bounded = F.rlike(low, F.concat(F.lit(r"(?<![a-z0-9])\Q"), name, F.lit(r"\E(?![a-z0-9])")))
    return F.when(name.rlike(f"[{CJK}]"), F.contains(low, name)).otherwise(bounded)


def normal_section(c: Column) -> Column:
    """Section numbers as 3.2, A.1 or A; else the lower-cased text."""
    t = F.trim(c)
    found = lambda pattern, group=1: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    tight = lambda x: F.regexp_replace(F.upper(x), r"\s+", "")
    letter, number = found(r"(?i)(?:appendix|附录)\s*([A-Z])(?:\s*\.\s*(\d+(?:\.\d+)*))?"), found(r"(?i)(?:appendix|附录)\s*([A-Z])(?:\s*\.\s*(\d+(?:\.\d+)*))?", 2)
    return F.coalesce(tight(found(r"(?i)sec\.?\s*([A-Z]\s*\.\s*\d+(?:\.\d+)*)")), found(r"(?i)sec\.?\s*(\d+(?:\.\d+)*)"), F.when(letter.isNotNull(), F.concat_ws(".", F.upper(letter), number)), tight(found(r"\b([A-Z]\s*\.\s*\d+(?:\.\d+)*)")), found(r"(\d+(?:\.\d+)*)"), F.lower(t))


def normal_item(c: Column) -> Column:
    """Figures and tables as fig2 and tab3; else the lower-cased text."""
    t = F.trim(c)
    fig, tab = F.regexp_extract(t, r"(?i)(fig(?:ure)?|图)\s*(\d+)", 2), F.regexp_extract(t, r"(?i)(tab(?:le)?|表)\s*(\d+)", 2)
    return F.when(fig != "", F.concat(F.lit("fig"), fig)).when(tab != "", F.concat(F.lit("tab"), tab)).otherwise(F.lower(t))


def location(c: Column) -> Column:
    """STRUCT<sec, items, many>: the last section named, figures and tables in order, and
    whether there are several of either."""
    parts = F.filter(F.transform(F.split(blank(c), "[,，、;；]"), lambda p: F.trim(p)), lambda p: p != "")
    is_item = lambda p: p.rlike(r"(?i)(fig(?:ure)?|图|tab(?:le)?|表)\s*\d+")
    items = F.transform(F.filter(parts, is_item), normal_item)
    sections = F.transform(F.filter(parts, lambda p: ~is_item(p)), normal_section)
    return F.struct(F.element_at(F.when(F.size(sections) > 0, sections), -1).alias("sec"), items.alias("items"), ((F.size(items) >= 2) | (F.size(sections) >= 2)).alias("many"))


def estimated_tokens(c: Column) -> Column:
    """A text's tokens at 3.5 characters each: 0 if empty, 1 at least."""
    n = F.length(blank(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 3.5).cast("int")))


def vision_tokens(width: Column, height: Column) -> Column:
    edge = F.greatest(width, height) / 1024.0
    return F.floor(F.least(F.lit(2000.0), 1200.0 * F.greatest(F.lit(0.25), F.least(F.lit(1.0), edge * edge)))).cast("int")


def content_hash(c: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(blank(c), 256), 1, digits)


def normal_text(c: Column) -> Column:
    """White space of any kind as single blanks, none around; null counts as empty."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def text_score(gold: Column, found: Column) -> Column:
    """1 less the edit distance as a share of the gold text, 0 at least."""
    n = F.length(gold)
    return F.when(n == 0, (F.length(found) == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(gold, found) / n))


def safe_name(c: Column, most: int = 64) -> Column:
    """A file-safe identifier: word characters, points and hyphens, no leading marks."""
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-.]+", "_"), r"\.\.+", "."), r"^[._]+|[._]+$", ""), F.lit(most))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(blank(c), "<[^>]+>", " ")


def masked(c: Column) -> Column:
    """A secret with its ends alone; short ones are hidden whole."""
    return F.when(F.length(c) <= 8, F.lit("****")).otherwise(F.concat(F.left(c, F.lit(4)), F.lit("****"), F.right(c, F.lit(4))))


def uncited_paragraphs(c: Column, least: int = 200) -> Column:
    """Paragraphs of over ``least`` visible characters without a citation, 160 characters each."""
    from paperlake.operators.verify import CITATION

    blocks = F.filter(F.split(blank(c), r"\n\s*\n"), lambda b: ~b.rlike(CITATION))
    body = lambda b: F.array_join(F.filter(F.split(b, "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).rlike("^(#|```)")), "")
    plain = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(body(b), "[*_>`~-]", ""), r"(?U)\s+", ""))
    return F.transform(F.filter(plain, lambda p: F.length(p) > least), lambda p: F.left(p, F.lit(160)))


def draft_language(c: Column) -> Column:
    """zh if CJK characters are two at least and twice the Latin words, else en."""
    cjk, latin = F.regexp_count(blank(c), F.lit(f"[{CJK}]")), F.regexp_count(blank(c), F.lit("[A-Za-z]+"))
    return F.when(cjk >= F.greatest(F.lit(2), 2 * latin), F.lit("zh")).otherwise(F.lit("en"))
