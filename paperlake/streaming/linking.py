"""Links of notes as they arrive: an inverted index as streaming state.

Notes come with growing ids. Three keyed states do what a batch over all notes does, without
reading old notes again:

* a keyword holds the first ``most`` notes that have it, which are all it can ever offer, as the
  smallest ids count;
* a note, once its offers are there, takes the ``most`` smallest of them and links to the first
  ``forward`` that fit (``graph.should_link``);
* a linked note counts its links back and takes no more than ``backward``.

A keyword that many notes have stays ``most`` entries, and a batch's notes of one keyword are
offered the same entries, so no state grows with the notes. Notes that share no keyword with an
earlier one get no link here (a batch falls back on the newest before them).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperlake.operators.graph import should_link

OFFERS = "id long, k array<string>, other long, l array<string>"


class Keyword(StatefulProcessor):
    """Offers the first holders of a keyword to the notes that ask for it, and keeps them."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holders = handle.getListState("holders", "id long, k array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        held = [(int(i), list(k)) for i, k in self.holders.get()] if self.holders.exists() else []
        before, out = len(held), []
        for row in pd.concat(frames).sort_values("id").itertuples(index=False):
            if row.asks:
                out += [(row.id, list(row.k), i, k) for i, k in held if i < row.id]
            if row.holds and len(held) < self.most:
                held.append((int(row.id), list(row.k)))
        if len(held) > before:
            self.holders.put(held)
        if out:
            yield pd.DataFrame(out, columns=["id", "k", "other", "l"])

    def close(self) -> None:
        pass


class Room(StatefulProcessor):
    """Lets the first links to a note through."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        n = self.taken.get()[0] if self.taken.exists() else 0
        ids = sorted(int(i) for f in frames for i in f["src"])[: self.most - n]
        if ids:
            self.taken.update((n + len(ids),))
            yield pd.DataFrame({"src": ids, "dst": [int(key[0])] * len(ids)})

    def close(self) -> None:
        pass


def offers(notes: DataFrame, most: int = 12, terms: int = 6) -> DataFrame:
    """(id, k, other, l): for each note of the stream ``notes`` (id, keywords, and findable if
    there is such a column) the earlier ones that have one of its first ``terms`` keywords,
    ``most`` of a keyword at most; k and l are both notes' keywords in small letters."""
    low = F.transform("keywords", F.lower)
    found = F.col("findable") if "findable" in notes.columns else F.lit(True)
    rows = notes.select("id", low.alias("k"), F.array_distinct(F.transform(F.slice("keywords", 1, terms), F.lower)).alias("first"), found.alias("found"))
    each = rows.select("id", "k", "first", "found", F.explode(F.array_distinct("k")).alias("w")).select("w", "id", "k", F.array_contains("first", F.col("w")).alias("asks"), F.col("found").alias("holds"))
    return each.groupBy("w").transformWithStateInPandas(Keyword(most), OFFERS, "Append", "None")


def chosen(offered: DataFrame, most: int = 12, forward: int = 6, least: float = 0.28) -> DataFrame:
    """(src, dst) of a batch of offers, in which all those of a note are: the ``most`` smallest
    are looked at, the first ``forward`` that fit are taken."""
    from paperlake.operators.common import top

    pairs = offered.dropDuplicates(["id", "other"])
    near = top(pairs, ["id"], [F.asc("other")], most).drop("rank")
    fits = near.where(should_link(F.array_distinct("k"), F.array_distinct("l"), least))
    return top(fits, ["id"], [F.asc("other")], forward).select(F.col("id").alias("src"), F.col("other").alias("dst"))


def rooms(links: DataFrame, backward: int = 24) -> DataFrame:
    """(src, dst) of the stream ``links`` (src growing from batch to batch, so a batch of notes is
    one of links) that the linked notes have room for, the smallest ids
    of a batch first."""
    return links.groupBy("dst").transformWithStateInPandas(Room(backward), "src long, dst long", "Append", "None")
