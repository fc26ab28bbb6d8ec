"""Text functions of reading notes and model answers: prose, first sentences, JSON, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.terms import evenly
from paperlake.functions.text import blank, sentences, tokens

# fixed values: the shape of a paper id and of a citation, and who may ask questions
PAPER_ID = r"^\d{4}_[A-Za-z0-9\-]+_\d{2,}$"
REFERENCE = r"\[Ref:[^\]]*\]"
PERSPECTIVES = ["方法学家", "统计学家", "实践者", "怀疑者"]


def valid_paper_id(c: Column) -> Column:
    return F.coalesce(c.rlike(PAPER_ID), F.lit(False))


def cache_key(*parts: Column) -> Column:
    """The first 32 digits of the SHA-256 of the stripped parts, joined by bars; null if a part
    is null or blank, as such a key would mix what differs."""
    stripped = [F.btrim(p, F.lit(" \n\t\r")) for p in parts]
    missing = F.lit(False)
    for p in stripped:
        missing = missing | F.coalesce(p == "", F.lit(True))
    return F.when(~missing, F.left(F.sha2(F.concat_ws("|", *stripped), 256), F.lit(32)))


def prose(text: Column) -> Column:
    """A text's lines as one line of prose: quotes, fences and blank lines go, and so do marks
    of lists."""
    lines = F.transform(F.split(F.regexp_replace(blank(text), r"\r\n?", "\n"), "\n"), lambda x: F.btrim(x, F.lit(" \t")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith(">") & ~x.startswith("```"))
    bare = F.transform(kept, lambda x: F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s*", ""))
    return F.array_join(F.filter(bare, lambda x: x != ""), " ")


def first_sentences(text: Column, n: int = 1, cap: int = 160) -> Column:
    """The first ``n`` sentences of over four characters; beyond ``cap`` characters they are cut,
    and citations that the cut took off are put behind the dots."""
    found = F.filter(F.transform(sentences(prose(text)), lambda s: F.trim(s)), lambda s: F.length(s) > 4)
    whole = F.trim(F.array_join(F.slice(found, 1, n), " "))
    short = F.concat(F.rtrim(F.left(whole, F.lit(cap))), F.lit("…"))
    lost = F.filter(F.array_distinct(F.regexp_extract_all(whole, F.lit(REFERENCE), F.lit(0))), lambda r: ~F.contains(short, r))
    return F.when(F.length(whole) <= cap, whole).otherwise(F.concat(short, F.array_join(F.transform(lost, lambda r: F.concat(F.lit(" "), r)), "")))


def json_of(answer: Column) -> Column:
    """The JSON text in a model's answer: in a fence, else from the first bracket or brace to its
    last counterpart, else the whole; null if none of them parses."""
    good = lambda c: F.when(F.expr("1 = 1") & F.try_parse_json(c).isNotNull() & (F.trim(c) != ""), F.trim(c))
    fenced = F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    bare = F.regexp_extract(answer, r"(\[[\s\S]*\]|\{[\s\S]*\})", 1)
    return F.coalesce(good(fenced), good(bare), good(answer))


def question_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def focus_rank(found: Column, focus: Column) -> Column:
    """Sentences that share words with ``focus`` first, by how many (then in order), the others
    as they come; without a word in ``focus`` all as they come."""
    want = F.array_distinct(tokens(focus))
    rows = F.transform(found, lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(s)), want))).alias("n"), i.alias("i"), s.alias("s")))
    return F.when(F.size(want) == 0, found).otherwise(F.transform(F.array_sort(rows), lambda x: x["s"]))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed one time, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract(text: Column, most: int | Column, must_have: Column | None = None, keep: int = 6) -> Column:
    """A summary of up to ``most`` characters: the text's sentences up to the first that doesn't
    fit; with ``must_have`` (words) only the ``keep`` that have most of them, and equal ones,
    each in its place. If nothing fits, the text's beginning; never null."""
    most = F.lit(most) if isinstance(most, int) else most
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    step = lambda a, s: F.when(a["full"] | (F.length(a["out"]) + F.length(s) + 1 > most), F.struct(a["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["out"], s, F.lit(" ")).alias("out"), F.lit(False).alias("full")))
    fitted = lambda found: F.rtrim(F.aggregate(found, zero, step)["out"])

    def chosen(found: Column) -> Column:
        low = F.transform(F.coalesce(must_have, F.array().cast("array<string>")), F.lower)
        by_hits = F.transform(found, lambda s, i: F.struct((-F.size(F.filter(low, lambda w: F.contains(F.lower(s), w)))).alias("n"), i.alias("i"), s.alias("s")))
        best = F.transform(F.slice(F.array_sort(by_hits), 1, keep), lambda x: x["s"])
        some = once(best, lambda b: F.filter(found, lambda s: F.array_contains(b, s)))
        return F.when(F.size(low) > 0, some).otherwise(found)

    out = once(sentences(text), lambda found: fitted(found if must_have is None else chosen(found)))
    return once(out, lambda o: F.when(o != "", o).otherwise(F.left(blank(text), most)))


def even_reduced(parts: Column, most: int) -> Column:
    """Parts in their order within ``most`` characters, an equal share for each; if there are
    more than could have a character, those at equal distances, the first and the last among
    them."""
    if most <= 0:
        return F.lit("")

    def reduced(parts: Column) -> Column:
        each = F.greatest(F.lit(1), F.floor((most - (F.size(parts) - 1)) / F.greatest(F.size(parts), F.lit(1))).cast("int"))
        many = F.left(F.array_join(F.transform(parts, lambda p: extract(p, each)), " "), F.lit(most))
        return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, F.left(F.get(parts, F.lit(0)), F.lit(most))).otherwise(many)

    whole = F.filter(parts, lambda p: F.rlike(p, F.lit(r"\S")))
    return once(whole, lambda w: once(evenly(w, max(1, (most + 1) // 2)), reduced))


def digested(text: Column, most: int, must_have: Column | None = None, window: int = 3000, each: int = 500) -> Column:
    """A digest of up to ``most`` characters: of a text up to twice as long its extract, else
    extracts of all its windows, reduced evenly; null and empty texts have an empty one."""
    t = blank(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(window))
    parts = F.transform(starts, lambda i: extract(F.substring(t, i + 1, F.lit(window)), each, must_have))
    return F.when(F.length(t) <= 2 * most, extract(t, most, must_have)).otherwise(even_reduced(parts, most))


def take_fitting(found: Column, budget: int | Column, text: Column) -> Column:
    """Different sentences, joined by blanks, up to the first that doesn't fit ``budget``
    characters; if even the first doesn't, the text's beginning."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    step = lambda a, s: F.when(a["full"] | (F.length(a["out"]) + F.length(s) + 1 > budget), F.struct(a["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["out"], s, F.lit(" ")).alias("out"), F.lit(False).alias("full")))
    out = F.trim(F.aggregate(F.array_distinct(found), zero, step)["out"])
    return F.when(out != "", out).otherwise(F.left(blank(text), budget))
