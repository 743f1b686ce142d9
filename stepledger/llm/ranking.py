"""Ranked lexical search of a set of items over all documents, by a search in two trees.

A document is a vector over the items' terms: term by term what it would add to a score. An item is a set of terms. Both are put
in order so that alike ones stand together, and hierarchies are laid over both: a node of documents holds the
greatest value of each term below it, a node of items the union of their terms. The sum of the first over the second is at
least every score between the two nodes. So if it is below the weakest ``k``-th score of these items, the
whole batch of documents is done with for the whole batch of items, exactly.

Texts are read once per block of items and become short vectors in a work table. Every task keeps its own ``k`` best
per item, and starts from a bound instead of from nothing: the ``k``-th score among a fixed share of the documents, which the
``k``-th score of all can only exceed. Items come to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.storage import materialize

#: Items that are looked for in one pass over the documents, in bytes of their texts.
ITEM_BYTES = 1 << 20
#: Documents, and values of their vectors, under one tree.
TREE_ROWS, TREE_VALUES = 4096, 1 << 21
FAN = 4
#: One in so many documents gives the first bounds.
SEED_SHARE = 32
_SLICE = 1 << 20
_ENDLESS = 1 << 63

#: Fixed values of the score: saturation and length, and the units of its whole numbers.
UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE, WEIGHT_UNIT = 1_000_000_000, 1000, 20, 50, 1000

_TERM_BYTE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


# ---- texts and scores ----


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists: runs of ASCII letters, digits and all other characters, only A-Z lower-cased."""
    spaced, at = text.translate(_TERM_BYTE), 0
    while at < len(spaced):
        cut = spaced.find(b" ", at + _SLICE)
        cut = len(spaced) if cut < 0 else cut
        yield spaced[at:cut].split()
        at = cut


def weight(documents: int, holders: int) -> int:
    return math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * holders + 1)))


def gains(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What occurrences add to a score, before the term's weight, given the document's relative length ``m``."""
    return UNIT * tf // (TF_UNIT * tf + LENGTH_UNIT * length)


def relative_length(n: int, documents: int, total: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total


# ---- trees ----


class Rows:
    """Sparse rows: ``ids[ptr[r]:ptr[r + 1]]`` and the values at these places."""

    def __init__(self, ptr: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        self.ptr, self.ids, self.values = ptr, ids, values

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ptr[rows] - ptr[:-1], sizes) + np.arange(ptr[-1])
        return Rows(ptr, self.ids[at], self.values[at])

    def sums(self, at: np.ndarray) -> np.ndarray:
        """Per row the sum of ``at`` over its places."""
        before = np.concatenate([np.zeros(1, at.dtype), np.cumsum(at)])
        return before[self.ptr[1:]] - before[self.ptr[:-1]]

    def merged(self, starts: np.ndarray) -> Rows:
        """One row for each run of rows: the greatest value of every id."""
        run = np.repeat(np.searchsorted(starts, np.arange(len(self)), "right") - 1, np.diff(self.ptr))
        order = np.lexsort((self.ids, run))
        run, ids, values = run[order], self.ids[order], self.values[order]
        new = np.ones(len(ids), bool)
        new[1:] = (run[1:] != run[:-1]) | (ids[1:] != ids[:-1])
        first = np.flatnonzero(new)
        most = np.maximum.reduceat(values, first) if len(first) else values
        return Rows(np.searchsorted(run[first], np.arange(len(starts) + 1)), ids[first], most)


def alike_order(rows: Rows, width: int) -> np.ndarray:
    """An order in which rows alike stand together: halved again and again between a strong row and one unlike it."""
    room, order = np.zeros(width), np.arange(len(rows))

    def likeness(part: Rows, to: int) -> np.ndarray:
        own = slice(part.ptr[to], part.ptr[to + 1])
        room[part.ids[own]] = part.values[own]
        found = part.sums(part.values * room[part.ids])
        room[part.ids[own]] = 0
        return found

    waiting = [(0, len(rows))]
    while waiting:
        a, b = waiting.pop()
        if b - a <= FAN:
            continue
        part = rows.take(order[a:b])
        part = Rows(part.ptr, part.ids, part.values.astype(np.float64))
        size = np.sqrt(np.maximum(part.sums(part.values**2), 1e-300))
        strong = int(size.argmax())
        near = likeness(part, strong) / size
        far = likeness(part, int(near.argmin())) / size
        # Likeness to the one and the other, then strength, which also parts rows of one kind.
        order[a:b] = order[a:b][np.argsort(near - far, kind="stable")]
        middle = (a + b) // 2
        waiting += [(a, middle), (middle, b)]
    return order


class Tree:
    """Levels of nodes over rows in an order of likeness: level 0 are the rows, and ``FAN`` neighbours make a node above."""

    def __init__(self, rows: Rows, width: int) -> None:
        self.order = alike_order(rows, width)
        self.levels = [rows.take(self.order)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].merged(np.arange(0, len(self.levels[-1]), FAN)))

    def lowest(self, values: np.ndarray) -> list[np.ndarray]:
        """Per level and node the least of the rows' ``values`` (given in the tree's order)."""
        out = [values]
        for _ in self.levels[1:]:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
        return out


class Items:
    """The items of one block: a tree over their terms, and what is known of each one's ``k``-th score."""

    def __init__(self, terms_of: list[list[int]], width: int) -> None:
        sizes = [len(t) for t in terms_of]
        ids = np.array([t for own in terms_of for t in own], np.int64)
        self.tree = Tree(Rows(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), ids, np.ones(len(ids), np.int64)), width)
        self.width = width
        #: Of each item, in the tree's order: a score and doc_id that the ``k``-th best is as good as.
        self.score = np.ones(len(terms_of), np.int64)
        self.doc = [_ENDLESS] * len(terms_of)

    def start_from(self, known: dict[int, tuple[int, int]]) -> None:
        for place, item in enumerate(self.tree.order.tolist()):
            if item in known:
                self.score[place], self.doc[place] = known[item]


class Search:
    """The ``k`` best documents of every item among those that one task has seen."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        self.score, self.doc = items.score.copy(), list(items.doc)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in self.doc]
        self.room = np.zeros(items.width, np.int64)
        self.weakest = items.tree.lowest(self.score)
        #: Pairs of nodes looked at, and pairs of single rows among them.
        self.pairs = self.scored = 0

    def add(self, rows: Rows, ids: list[int]) -> None:
        """Search all ``rows`` of documents with ``ids``; an id of ``2**63`` stands for none and comes last."""
        tree = Tree(rows, self.items.width)
        placed = [ids[r] for r in tree.order.tolist()]
        first = [placed]
        for _ in tree.levels[1:]:
            first.append([min(first[-1][a : a + FAN]) for a in range(0, len(first[-1]), FAN)])
        top = len(self.items.tree.levels) - 1
        waiting = [(len(tree.levels) - 1, 0, top, np.zeros(1, np.int64))] if len(rows) and self.doc else []
        while waiting:
            level, node, height, others = waiting.pop()
            docs = tree.levels[level]
            own = slice(docs.ptr[node], docs.ptr[node + 1])
            self.room[docs.ids[own]] = docs.values[own]
            while True:
                others, bounds = self._open(height, others, first[level][node])
                if level or not height or not len(others):
                    break
                height, others = height - 1, self._below(height, others)
            self.room[docs.ids[own]] = 0
            if not len(others):
                continue
            if level:
                under = self._below(height, others) if height else others
                children = range(FAN * node, min(FAN * node + FAN, len(tree.levels[level - 1])))
                waiting += [(level - 1, child, max(height - 1, 0), under) for child in children]
            else:
                self._keep(placed[node], others, bounds)

    def _below(self, height: int, nodes: np.ndarray) -> np.ndarray:
        under = (FAN * nodes[:, None] + np.arange(FAN)).ravel()
        return under[under < len(self.items.tree.levels[height - 1])]

    def _open(self, height: int, nodes: np.ndarray, least_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of items that may still want a document of the present node, and the bounds of their scores."""
        found = self.items.tree.levels[height].take(nodes)
        bounds = found.sums(self.room[found.ids])
        weakest = self.weakest[height][nodes]
        self.pairs += len(nodes)
        if height:
            wanted = bounds >= weakest
        else:
            wanted = bounds > weakest
            for n in np.flatnonzero(bounds == weakest).tolist():
                wanted[n] = least_id <= self.doc[nodes[n]]
        return nodes[wanted], bounds[wanted]

    def _keep(self, doc: int, places: np.ndarray, scores: np.ndarray) -> None:
        changed = False
        self.scored += len(places)
        for place, score in zip(places.tolist(), scores.tolist(), strict=True):
            heap = self.heaps[place]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))
            if len(heap) == self.k and (heap[0][0], -heap[0][1]) != (self.score[place], self.doc[place]):
                # Rows kept reach the bound that the search began with, so a full heap is never below it.
                self.score[place], self.doc[place], changed = heap[0][0], -heap[0][1], True
        if changed:
            self.weakest = self.items.tree.lowest(self.score)

    def found(self) -> Iterator[tuple[int, int, int]]:
        """``(item, doc, score)``."""
        for item, heap in zip(self.items.tree.order.tolist(), self.heaps, strict=True):
            for score, doc in heap:
                yield item, -doc, score


# ---- all documents ----

_VECTOR = "doc_id bigint, n bigint, terms binary, counts binary"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of documents with a term: all their terms counted, those of the vocabulary listed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                n, seen = 0, Counter()
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    seen.update(filter(vocabulary.__contains__, part))
                if n:
                    held = sorted((vocabulary[t], c) for t, c in seen.items())
                    out[0].append(doc_id)
                    out[1].append(n)
                    out[2].append(np.array([t for t, _ in held], np.int32).tobytes())
                    out[3].append(np.array([c for _, c in held], np.int64).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["doc_id", "n", "terms", "counts"])

    return docs.select(B.field("doc_id").cast("bigint").alias("doc_id"), B.field("text").cast("string").alias("text")).mapInArrow(work, _VECTOR)


def _statistics(table: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and the holders of each term of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32)
            held += np.bincount(ids, minlength=width)[:width]
            documents, total = documents + batch.num_rows, total + sum(batch["n"].to_pylist())
        at = np.flatnonzero(held)
        names = np.concatenate([at, [width, width + 1]])
        yield pa.RecordBatch.from_pydict({"name": names, "value": np.concatenate([held[at], [documents, total]])})

    found = table.select("n", "terms").mapInArrow(work, "name bigint, value bigint").groupBy("name").agg(F.sum("value").alias("value"))
    sums = {r["name"]: r["value"] for r in found.collect()}  # at most the terms of one block of items
    return sums.get(width, 0), sums.get(width + 1, 0), np.array([sums.get(t, 0) for t in range(width)], np.int64)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return candidates.withColumn("rank", place).where(F.col("rank") <= k)


def _candidates(table: DataFrame, items: Items, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the best of every partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held = Search(items, k), []

        def flush() -> None:
            whole = pa.Table.from_batches(held)
            held.clear()
            sizes = np.array([len(x) // 4 for x in whole["terms"].to_pylist()], np.int64)
            ids, tf = B.joined(whole, "terms", np.int32).astype(np.int64), B.joined(whole, "counts", np.int64)
            length = np.array([relative_length(n, documents, total) for n in whole["n"].to_pylist()], np.int64)
            values = weights[ids] * gains(tf, np.repeat(length, sizes))
            rows = Rows(np.concatenate([[0], np.cumsum(sizes)]), ids, values)
            search.add(rows, [_ENDLESS if d is None else d for d in whole["doc_id"].to_pylist()])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TREE_ROWS or sum(b["terms"].nbytes for b in held) >= 4 * TREE_VALUES:
                flush()
        if held:
            flush()
        found = list(search.found())
        item, doc, score = zip(*found, strict=True) if found else ((), (), ())
        docs = pa.array([None if d == _ENDLESS else d for d in doc], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), docs, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return table.mapInArrow(work, "item int, doc_id bigint, score bigint")


def _one_block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """``item_id, rank, doc_id, score`` for the items of one block."""
    spark = docs.sparkSession
    names = [sorted({t for part in terms((r["text"] or "").encode()) for t in part}) for r in rows]
    vocabulary = {t: n for n, t in enumerate(sorted({t for own in names for t in own}))}
    if not vocabulary:
        return None
    table = materialize(vectors(docs, vocabulary), "vectors")
    documents, total, holders = _statistics(table, len(vocabulary))
    weights = np.array([weight(documents, int(h)) for h in holders], np.int64)
    items = Items([[vocabulary[t] for t in own] for own in names], len(vocabulary))
    seeds = table.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SEED_SHARE)) == 0)
    last = _ranked(_candidates(seeds, items, weights, documents, total, k), k).where(F.col("rank") == k)
    items.start_from({r["item"]: (r["score"], _ENDLESS if r["doc_id"] is None else r["doc_id"]) for r in last.collect()})  # a row per item
    found = _ranked(_candidates(table, items, weights, documents, total, k), k)
    own = spark.createDataFrame([(n, r["item_id"], r["times"]) for n, r in enumerate(rows)], "item int, item_id bigint, times bigint")
    every = found.join(own, "item").select("item_id", "rank", "doc_id", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return every.drop("col")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above zero.

    Equal scores rank by ascending doc_id, null ids last. A null or empty text has no term; such documents do not count,
    and such items have no rows. Rows of documents with equal ids are documents each; an item row that is repeated has its
    result as often, with the same ranks. Empty tables give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    B.bounded_batches(spark)
    wanted = items.select(B.field("item_id").cast("bigint").alias("item_id"), B.field("text").cast("string").alias("text"))
    wanted = wanted.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    blocks = B.parts(B.text_bytes(wanted), ITEM_BYTES)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        # One block of bounded size at a time passes the driver.
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = _one_block(docs, rows, k)
        if found is not None:
            out = out.unionByName(materialize(found, "ranked") if blocks > 1 else found)
    return out
