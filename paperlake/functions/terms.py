"""Term management over texts: one name for one thing, and how well a text keeps to it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import CJK, blank


def _pattern(term: str) -> str:
    quoted = re.escape(term)
    return quoted if re.search(f"[{CJK}]", term) else rf"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])"


def unified(text: Column, aliases: dict[str, str]) -> Column:
    """Aliases by their canonical names, the longest first, in any case. Text that has the
    canonical name already stays as it is."""
    for alias in sorted(aliases, key=lambda a: (-len(a), a)):
        text = F.regexp_replace(text, f"(?iu){_pattern(alias)}", aliases[alias].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def consistency(text: Column, aliases: dict[str, str]) -> Column:
    """The share of all managed terms found that are canonical to the letter; 1 if none is."""
    names = sorted({*aliases, *aliases.values()}, key=lambda a: (-len(a), a))
    if not names:
        return F.lit(1.0)
    found = F.regexp_extract_all(blank(text), F.lit("(?iu)" + "|".join(_pattern(n) for n in names)), F.lit(0))
    good = F.lit(sorted(set(aliases.values())))
    return F.when(F.size(found) == 0, 1.0).otherwise(F.round(F.size(F.filter(found, lambda x: F.array_contains(good, x))) / F.size(found), 4))


def evenly(items: Column, most: int) -> Column:
    """Up to ``most`` items at equal distances, the first and the last among them; places are
    rounded halves to even."""
    n = F.size(items)
    place = lambda i: F.bround(i * (n - 1) / float(max(1, most - 1)), 0).cast("int")
    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), place))
    return F.when(n <= most, items).otherwise(F.transform(picked, lambda i: F.get(items, i)))


# fixed values: words that tell what a section is about, and the sentences between sections
ABOUT = {
    "problem": ["background", "intro", "problem", "overview", "背景", "引言", "问题", "综述"],
    "method": ["method", "model", "approach", "architecture", "theory", "方法", "模型", "架构", "理论"],
    "evaluation": ["experiment", "result", "evaluation", "ablation", "study", "实验", "结果", "评估", "消融"],
    "conclusion": ["conclusion", "summary", "limit", "takeaway", "discussion", "结论", "总结", "局限", "讨论"],
}
BETWEEN = {
    "to_method": {"en": "Building on the problem framing in {p}, {c} now develops the method and its underlying design rationale.", "zh": "承接{p}的问题界定，{c}进一步展开方法设计及其理论依据。"},
    "to_evaluation": {"en": "Having established the method in {p}, {c} evaluates its claims through empirical results and controlled comparisons.", "zh": "在{p}确立方法之后，{c}通过实证结果与受控比较检验其核心主张。"},
    "to_conclusion": {"en": "With the evidence from {p} established, {c} consolidates the findings, limitations, and remaining open questions.", "zh": "基于{p}的证据，{c}归纳主要发现、适用边界与尚未解决的问题。"},
    "claim": {"en": "Building on the preceding claim that “{p}”, {c} extends the argument to the next part of the analysis.", "zh": "承接上一节关于“{p}”的论述，{c}将论证推进至下一分析层次。"},
    "plain": {"en": "Building on {p}, {c} advances the next stage of the argument.", "zh": "承接{p}的论证，{c}推进下一层分析。"},
}


def section_label(h1: Column, h2: Column, language: Column) -> Column:
    """A section's name in a sentence: both headings if they differ."""
    alone = F.when(h1 != "", h1).when(language == "zh", "下一节").otherwise("the next section")
    both = F.when(language == "zh", F.concat(h1, F.lit("（"), h2, F.lit("）"))).otherwise(F.concat(h1, F.lit(" ("), h2, F.lit(")")))
    return F.when((h2 == "") | (F.lower(h1) == F.lower(h2)), alone).otherwise(both)


def transition(before: Column, after: Column, language: Column) -> Column:
    """A sentence that leads from one section (struct h1, h2, claims) to the next, chosen by what
    their headings are about, else by the first claim, in the draft's language."""
    text = lambda s, c: F.trim(F.coalesce(s[c], F.lit("")))
    title = lambda s: F.lower(F.concat(text(s, "h1"), F.lit(" "), text(s, "h2")))
    has = lambda s, words: title(s).rlike("|".join(words))
    labels = {"p": section_label(text(before, "h1"), text(before, "h2"), language), "c": section_label(text(after, "h1"), text(after, "h2"), language)}
    claim = F.trim(F.regexp_replace(F.coalesce(F.get(before["claims"], F.lit(0)), F.lit("")), r"\s+", " "))
    quoted = F.when(F.length(claim) > 60, F.concat(F.left(claim, F.lit(60)), F.lit("..."))).otherwise(claim)

    def said(name: str, **words: Column) -> Column:
        def filled(pattern: str) -> Column:
            out = []
            for i, part in enumerate(re.split(r"\{(.)\}", pattern)):
                out.append((labels | words)[part] if i % 2 else F.lit(part))
            return F.concat(*out)

        return F.when(language == "en", filled(BETWEEN[name]["en"])).otherwise(filled(BETWEEN[name]["zh"]))

    to_method = has(before, ABOUT["problem"]) | has(after, ABOUT["method"])
    to_evaluation = has(before, [*ABOUT["method"], "algorithm", "算法"]) | has(after, ABOUT["evaluation"])
    to_conclusion = has(before, [*ABOUT["evaluation"], "discussion", "讨论"]) | has(after, ABOUT["conclusion"])
    by_claim = (F.length(claim) > 10) & ~claim.startswith("c")
    return F.when(to_method, said("to_method")).when(to_evaluation, said("to_evaluation")).when(to_conclusion, said("to_conclusion")).when(by_claim, said("claim", p=quoted)).otherwise(said("plain"))


def heading_key(c: Column) -> Column:
    """A heading for comparison: any case, single blanks, none around slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "), r"\s*/\s*", "/"))
