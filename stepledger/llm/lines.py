"""Line dedup: documents probe a sharded minimal perfect hash of line hashes instead of joining lines.

A line's key is the line without the six ASCII white-space characters at its ends, A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the document with
the largest doc_id.

Each block sends every shard its distinct key hashes (128 bits), with the number of its documents that hold the key and
their largest doc_id. The shard builds a minimal perfect hash over the distinct hashes; it indexes a fingerprint, a
count and a doc_id array, which the messages fill and then probe.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from stepledger.llm import blocks as B
from stepledger.llm.mph import PerfectHash

_SPACE = b" \t\n\x0b\x0c\r"
_NO_ID = np.iinfo(np.int64).min

_MESSAGE = "shard int, block int, first binary, second binary, docs binary, last binary"
_ANSWER = "block int, shard int, last binary"


class LineIndex:
    """The arrays of one shard: fingerprint, number of documents and largest doc_id by slot of the perfect hash."""

    def __init__(self, first: np.ndarray, second: np.ndarray, docs: np.ndarray, last: np.ndarray) -> None:
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.hash = PerfectHash(a[new], b[new])
        self.fingerprint = np.zeros(self.hash.size, np.uint64)
        self.fingerprint[self.hash.slots(a[new], b[new])] = b[new]
        self.count = np.zeros(self.hash.size, np.int64)
        self.last = np.full(self.hash.size, _NO_ID, np.int64)
        slots = self.hash.slots(first, second)
        np.add.at(self.count, slots, docs)
        np.maximum.at(self.last, slots, last)

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and largest doc_id of each key, 0 and the smallest number for keys that are not in the set."""
        slots = self.hash.slots(first, second)
        known = slots >= 0
        known[known] = self.fingerprint[slots[known]] == second[known]
        count, last = np.zeros(len(first), np.int64), np.full(len(first), _NO_ID, np.int64)
        count[known], last[known] = self.count[slots[known]], self.last[slots[known]]
        return count, last


def _line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _holdings(texts: Iterable[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, first, second)``: one entry per document and distinct key in it."""
    owner, digests = [], []
    for number, text in enumerate(texts):
        found = {k for k in (_line_key(x, min_chars) for x in text.split(b"\n")) if k is not None}
        held = sorted(xxhash.xxh3_128_digest(k) for k in found)
        digests += held
        owner += [number] * len(held)
    pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.array(owner, np.int64), pairs[:, 0].copy(), pairs[:, 1].copy()


class _Held:
    """The distinct keys of a block and the documents that hold them."""

    def __init__(self, block: B.Block, min_chars: int, shards: int) -> None:
        self.ids = block.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.owner, first, second = _holdings(block.texts(), min_chars)
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first, self.second = a[new], b[new]
        self.of_entry = np.zeros(len(order), np.int64)
        self.of_entry[order] = np.cumsum(new) - 1
        self.shard = (self.first % np.uint64(shards)).astype(np.int64)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, kept_sha256, row``: the text that stays, per row of ``docs``.

    A null or empty text is one empty line; it comes back as an empty text. Rows count as documents each, also those
    with equal doc_ids, which are kept or lose lines alike. A null doc_id is smaller than all others. ``row`` has all
    columns of the input.
    """
    total = B.text_bytes(docs)
    shards = B.parts(total, B.SHARD_BYTES)
    placed = B.dealt(docs, B.parts(total, B.BLOCK_BYTES))

    def ask(table: pa.Table) -> pa.Table:
        block = B.Block(table)
        held = _Held(block, min_chars, shards)
        holders = np.bincount(held.of_entry, minlength=len(held.first)).astype(np.int64)
        last = np.full(len(held.first), _NO_ID, np.int64)
        np.maximum.at(last, held.of_entry, held.ids[held.owner])
        return B.send(block.number, held.shard, {"first": held.first, "second": held.second, "docs": holders, "last": last})

    def decide(messages: pa.Table) -> pa.Table:
        first, second = B.joined(messages, "first", np.uint64), B.joined(messages, "second", np.uint64)
        index = LineIndex(first, second, B.joined(messages, "docs", np.int64), B.joined(messages, "last", np.int64))
        count, last = index.probe(first, second)
        # The answer is the doc_id that keeps the line; the smallest number where all keep it.
        return B.cut(messages, np.where(count >= min_docs, last, _NO_ID), "last", 8, "first")

    def rebuild(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = B.Block(table)
        held = _Held(block, min_chars, shards)
        keeper = B.received(answers, "last", np.int64, held.shard)
        gone = (keeper[held.of_entry] != _NO_ID) & (keeper[held.of_entry] != held.ids[held.owner])
        lost: dict[int, set[bytes]] = {}
        for entry in np.flatnonzero(gone):
            key = held.of_entry[entry]
            digest = held.first[key].tobytes() + held.second[key].tobytes()
            lost.setdefault(int(held.owner[entry]), set()).add(digest)
        texts, n_lines, n_dropped, digests = [], [], [], []
        for number, text in enumerate(block.texts()):
            lines, drop = text.split(b"\n"), lost.get(number)
            n_lines.append(len(lines))
            if drop:
                lines = [x for x in lines if (k := _line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in drop]
                text = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            texts.append(text)
            digests.append(hashlib.sha256(text).hexdigest())
        return pa.table(
            {
                "doc_id": block.column("doc_id").cast(pa.int64()),
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_lines": pa.array(n_lines, pa.int64()),
                "n_dropped": pa.array(n_dropped, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "row": block.rows,
            }
        )

    answers = B.per_shard(B.per_block(placed, ask, _MESSAGE), decide, _ANSWER)
    schema = B.with_row("doc_id bigint, text string, n_lines bigint, n_dropped bigint, kept_sha256 string", placed)
    return B.with_answers(placed, answers, rebuild, schema)
