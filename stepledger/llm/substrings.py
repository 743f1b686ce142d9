"""Substring dedup over words: windows are hashed at the positions of a difference cover only, then extended.

A difference cover of period v is a set D such that any two positions i, j have a shift d < v with (i + d) mod v and
(j + d) mod v both in D. Anchors are windows of ``width - v + 1`` words that start at positions in D. If two windows of
``width`` words are equal, both hold the same anchor at the same shift; so a window without a repeated anchor is
unique. Round one finds the repeated anchors. Round two extends them: of all windows that hold a repeated anchor (at most
v - 1 words to either side), the whole ``width`` words are hashed, in 128 bits, and the repeated ones found. A hot
passage costs one entry per block in either round, and no pair is ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepledger.llm import blocks as B
from stepledger.llm.rolling import tables, word_values, words

#: A perfect difference set: every difference modulo 21 occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Windows of more words would need another hash, see ``rolling``.
MAX_WIDTH = 512

_MESSAGE = "shard int, block int, first binary, second binary, several binary, layout binary"
_ANSWER = "block int, shard int, repeated binary, layout binary"


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Words:
    """The words of all documents of a block, one after the other, as arrays."""

    def __init__(self, block: B.Block, width: int) -> None:
        self.texts = list(block.texts())
        sizes = np.array([len(x) + 1 for x in self.texts], np.int64)
        self.raw = b"\n".join([*self.texts, b""])
        letters = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = words(letters)
        self.one, self.two = tables()
        self.hashes, self.others = word_values(letters, self.starts, self.ends)
        #: Position of each document's first word, and of the end of the last.
        self.edges = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        counts = np.diff(self.edges)
        self.place = np.arange(len(self.starts)) - np.repeat(self.edges[:-1], counts)
        #: Does a whole window begin here?
        self.whole = np.repeat(counts, counts) - self.place >= width

    def anchors(self, period: int, in_cover: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors, of ``width - period + 1`` words; documents shorter than a window have none."""
        anchor = width - period + 1
        counts = np.diff(self.edges)
        left = np.repeat(counts, counts) - self.place
        at = np.flatnonzero(in_cover[self.place % period] & (left >= anchor) & np.repeat(counts >= width, counts))
        return at, self.one.windows(self.hashes, anchor, at)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    return found, back, (times > 1).astype(np.uint8)


def _distinct_pairs(first: np.ndarray, second: np.ndarray):
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.zeros(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[new], b[new], back, (np.bincount(back, minlength=int(new.sum())) > 1).astype(np.uint8)


def _covered(marks: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Places ``p`` of ``n`` with a mark in ``[p - before, p + after]``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(marks - after, 0), 1)
    np.add.at(change, np.minimum(marks + before + 1, n), -1)
    return np.cumsum(change[:n]) > 0


def dedup_substrings(
    docs: DataFrame, width: int = 35, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """``doc_id, text, n_words, n_removed, kept_sha256, row``: per row, the words that no repeated window covers.

    A window is ``width`` consecutive words of one row; it is repeated if its words also start anywhere else, in the same
    row or another (rows with equal ids are different places). The text that stays has its words joined by one space. A
    null or empty text has no words. ``row`` has all columns of the input.
    """
    if not is_cover(cover, period) or not period < width <= MAX_WIDTH:
        raise ValueError("cover must hold all differences modulo a period that is below the width, and that at most MAX_WIDTH")
    total = B.text_bytes(docs)
    shards = B.parts(total, B.SHARD_BYTES)
    placed = B.dealt(docs, B.parts(total, B.BLOCK_BYTES))
    in_cover = np.isin(np.arange(period), cover)

    def shard_of(keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(shards)).astype(np.int64)

    def ask(table: pa.Table) -> pa.Table:
        block = B.Block(table)
        _, keys = _Words(block, width).anchors(period, in_cover, width)
        keys, _, several = _distinct(keys)
        none = np.zeros((len(keys), 0), np.uint8)
        return B.send(block.number, shard_of(keys), {"first": keys, "second": none, "several": several, "layout": none})

    def window_keys(own: _Words, flags: np.ndarray):
        at = np.flatnonzero(flags)
        return at, _distinct_pairs(own.one.windows(own.hashes, width, at), own.two.windows(own.others, width, at))

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = B.Block(table)
        own = _Words(block, width)
        at, keys = own.anchors(period, in_cover, width)
        keys, back, _ = _distinct(keys)
        hit = B.received(answers, "repeated", np.uint8, shard_of(keys))[back].astype(bool)
        # A window holds an anchor if that begins at most period - 1 words after it.
        flags = _covered(at[hit], 0, period - 1, len(own.starts)) & own.whole
        _, (first, second, _, several) = window_keys(own, flags)
        none = np.zeros((len(first), 0), np.uint8)
        sent = B.send(block.number, shard_of(first), {"first": first, "second": second, "several": several, "layout": none})
        if not flags.any():
            return sent
        # The flags travel with the keys, so that the last round need not find them again.
        empty = np.zeros((1, 0), np.uint8)
        layout = {"first": empty, "second": empty, "several": empty, "layout": np.packbits(flags)[None, :]}
        return pa.concat_tables([sent, B.send(block.number, np.array([block.number % shards]), layout)])

    def decide(messages: pa.Table) -> pa.Table:
        first, second = B.joined(messages, "first", np.uint64), B.joined(messages, "second", np.uint64)
        hit = B.repeated(first, second if len(second) else None, B.joined(messages, "several", np.uint8))
        answers = B.cut(messages, hit.astype(np.uint8), "repeated", 8, "first")
        return answers.append_column("layout", messages["layout"].combine_chunks())

    def rebuild(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = B.Block(table)
        own = _Words(block, width)
        gone = np.zeros(len(own.starts), bool)
        layouts = answers["layout"].to_pylist()
        if any(layouts):
            flags = np.unpackbits(np.frombuffer(next(filter(None, layouts)), np.uint8), count=len(gone)).astype(bool)
            at, (first, _, back, _) = window_keys(own, flags)
            keyed = answers.filter(pa.array([not x for x in layouts]))
            hit = B.received(keyed, "repeated", np.uint8, shard_of(first))[back].astype(bool)
            gone = _covered(at[hit], width - 1, 0, len(gone))
        texts, n_removed = [], []
        for text, a, b in zip(own.texts, own.edges, own.edges[1:], strict=False):
            n_removed.append(int(gone[a:b].sum()))
            if n_removed[-1]:
                stays = np.flatnonzero(~gone[a:b]) + a
                texts.append(b" ".join([own.raw[x:y] for x, y in zip(own.starts[stays].tolist(), own.ends[stays].tolist(), strict=True)]))
            else:
                texts.append(b" ".join(text.split()))
        return pa.table(
            {
                "doc_id": block.column("doc_id").cast(pa.int64()),
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array(np.diff(own.edges), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                "row": block.rows,
            }
        )

    anchors = B.per_shard(B.per_block(placed, ask, _MESSAGE), decide, _ANSWER)
    windows = B.per_shard(B.with_answers(placed, anchors, extend, _MESSAGE), decide, _ANSWER)
    schema = B.with_row("doc_id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string", placed)
    return B.with_answers(placed, windows, rebuild, schema)
