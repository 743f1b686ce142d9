"""Benchmark decontamination: test items are found in documents up to an edit distance.

Texts are compared in lower case with every run of other characters than letters and digits as one space. An item of ``m``
characters may have ``k`` edits; it is cut into ``k + 1`` pieces, and whatever the edits are, one piece stays whole (pigeonhole).
An automaton over all pieces finds the exact hits in a document; around each, Myers' bit-parallel algorithm gives the least edit
distance of the item to any part of that stretch of text.

Items are taken in blocks of bounded size, one pass over the documents per block.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B

#: Edits allowed per character of an item. Pieces follow from it: some 12 characters, down to half as many in short items.
ERROR_RATE = 0.08
#: Characters of items that one pass looks for.
ITEM_BLOCK_CHARS = 1 << 20

Item = tuple[int | None, str]
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return int(error_rate * length)


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """Offsets and texts of ``edits + 1`` pieces of nearly equal length."""
    edges = [round(len(text) * k / (edits + 1)) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def least_distance(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text`` (Myers 1999, on integers of any size)."""
    if not pattern:
        return 0
    at: dict[str, int] = {}
    for k, char in enumerate(pattern):
        at[char] = at.get(char, 0) | 1 << k
    full, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    best = score
    for char in text:
        equal = at.get(char, 0)
        across = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (full & ~(diagonal | up)), up & diagonal
        if rises & high:
            score += 1
        elif falls & high:
            score -= 1
            best = min(best, score)
        rises, falls = (rises << 1) & full, (falls << 1) & full
        up, down = falls | (full & ~(across | rises)), rises & across
    return best


class Finder:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: tuple[Item, ...], error_rate: float) -> None:
        import ahocorasick

        self.items = [(item, text, budget(len(text), error_rate)) for item, text in items]
        wanted: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                wanted.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in wanted.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """``(item, least distance)`` of each item within its budget."""
        text, best, seen = normal(text), {}, set()
        for last, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                begin = last + 1 - size - offset
                if best.get(number) == 0 or (number, begin) in seen:
                    continue
                seen.add((number, begin))
                _, item, edits = self.items[number]
                if text[max(begin, 0) : begin + len(item)] == item:
                    best[number] = 0
                    continue
                distance = least_distance(item, text[max(0, begin - edits) : begin + len(item) + edits])
                if distance <= edits:
                    best[number] = min(distance, best.get(number, distance))
        return [(self.items[number][0], distance) for number, distance in sorted(best.items())]


@functools.lru_cache(maxsize=1)
def _finder(items: tuple[Item, ...], error_rate: float) -> Finder:
    return Finder(items, error_rate)


def item_blocks(items: DataFrame, chars: int = ITEM_BLOCK_CHARS) -> Iterator[tuple[Item, ...]]:
    """The items with text, in blocks of about ``chars`` characters; items without a letter or digit are left out."""
    rows = items.select(B.field("item_id").cast("bigint").alias("item_id"), B.field("text").alias("text"))
    block, held = [], 0
    for item, text in rows.where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        if text := normal(text):
            block.append((item, text))
            held += len(text)
            if held >= chars:
                yield tuple(block)
                block, held = [], 0
    if block:
        yield tuple(block)


def _found(docs: DataFrame, block: tuple[Item, ...], error_rate: float) -> DataFrame:
    """``row, hits``: what of one block of items a document holds."""

    @F.pandas_udf("array<struct<item_id: bigint, distance: int>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(block, error_rate)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in finder.find(x)] if x else [] for x in texts])

    return docs.select(B.packed_rows(docs)).select("row", hits(F.col("row.text")).alias("hits"))


def contaminations(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE
) -> DataFrame:
    """``doc_id, item_id, distance``: each item that a row of ``docs`` holds within the item's edit budget.

    Null and empty texts hold none, and items without a letter or digit are not looked for. Rows with equal ids report each;
    items with equal ids and different texts are different items.
    """
    found = [_found(docs, block, error_rate) for block in item_blocks(items)]
    if not found:
        return docs.select(B.field("doc_id").cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("distance")).limit(0)
    # The outer form keeps the planner from searching all texts twice, once for a filter on the number of hits.
    rows = [x.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.explode_outer("hits").alias("hit")) for x in found]
    return reduce(DataFrame.union, rows).where("hit IS NOT NULL").select("doc_id", "hit.item_id", "hit.distance")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE
) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for block in item_blocks(items):
        clean = _found(docs, block, error_rate).where(F.size("hits") == 0)
        docs = B.documents_of(clean, docs)
    return docs
