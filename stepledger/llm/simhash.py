"""SimHash near-duplicates: fingerprints that differ in few bits are found in blocks, verified, and joined to groups.

With ``p`` pieces of a fingerprint and at most ``d`` differing bits, at least ``p - d`` pieces agree. So for every choice of
``p - d`` pieces the fingerprints that agree on them form a block, and close pairs share one. Only distinct fingerprints
are looked at: any number of equal texts is one of them. The bits outside a block's pieces bound its size (six pieces and two
bits: 22 bits), and inside it every fingerprint probes those within ``d`` flips, not all others. A block returns
the smallest fingerprint that each of its members is linked to, so what it gives is at most what it gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.llm.components import components
from stepledger.storage import materialize

SHINGLE_WORDS, SEED = 3, 42
BITS, PIECES, DISTANCE = 64, 6, 2
_AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> bytes:
    """Eight bytes: a bit is 1 if it is set in over half of the shingles' hashes. No word: all zero."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return bytes(BITS // 8)
    joined = b" ".join(words)
    edges = np.cumsum([0, *(len(w) + 1 for w in words)])
    n = max(1, len(words) - width + 1)
    starts, ends = edges[:n].tolist(), (edges[min(width, len(words)) :][:n] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _AT_ONCE):
        part = [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _AT_ONCE], ends[k : k + _AT_ONCE], strict=True)]
        ones += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, h1, h2, fingerprint, bits``; ``h1, h2`` stand for id and text."""

    @F.pandas_udf("struct<fingerprint: string, bits: bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [fingerprint((x or "").encode(), width) for x in texts]
            yield pd.DataFrame({"fingerprint": [x.hex() for x in found], "bits": np.frombuffer(b"".join(found), ">i8").astype(np.int64)})

    keyed = B.blocked(docs, 1)
    return keyed.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "h1", "h2", of("row.text").alias("f")).select(
        "doc_id", "h1", "h2", "f.fingerprint", "f.bits"
    )


def masks(pieces: int, distance: int) -> list[int]:
    """For every choice of ``pieces - distance`` pieces, the bits that they have; as signed numbers."""
    edges = [round(BITS * k / pieces) for k in range(pieces + 1)]
    spans = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(spans, pieces - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _near(values: np.ndarray, free: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of ``values`` (sorted, distinct, equal outside the bits ``free``) with up to ``distance`` flips."""
    firsts, seconds = [], []
    flips = [sum(1 << b for b in c) for k in range(1, distance + 1) for c in combinations(free, k)]
    if len(values) <= len(flips):
        found = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
        first, second = np.nonzero(np.triu(found, 1))
        return first, second
    for flip in flips:
        other = values ^ np.uint64(flip)
        at = np.searchsorted(values, other)
        at[at == len(values)] = 0
        hit = np.flatnonzero((values[at] == other) & (other > values))
        firsts.append(hit)
        seconds.append(at[hit])
    return np.concatenate(firsts), np.concatenate(seconds)


def _least_linked(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest one that it is linked to, over any number of links."""
    least = np.arange(n)
    while len(first):
        before = least.copy()
        both = np.minimum(least[first], least[second])
        np.minimum.at(least, first, both)
        np.minimum.at(least, second, both)
        least = least[least]
        if np.array_equal(least, before):
            break
    return least


def links(distinct: DataFrame, pieces: int = PIECES, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``, ``a > b``: links that connect exactly what links of all close pairs of the column ``bits`` connect."""
    blocks = masks(pieces, distance)
    keys = F.array(*[F.struct(F.lit(k).alias("block"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(blocks)])
    members = (
        distinct.select("bits", F.explode(keys).alias("k"))
        .groupBy("k.block", "k.key")
        .agg(F.collect_list("bits").alias("members"))
        .where(F.size("members") > 1)
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for number, own in zip(batch["block"].to_pylist(), batch["members"], strict=True):
                values = np.sort(own.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                free = [k for k in range(BITS) if not (blocks[number] >> k) & 1]
                least = _least_linked(len(values), *_near(values, free, distance))
                moved = np.flatnonzero(least != np.arange(len(values)))
                pair = np.sort(np.stack([values[moved].view(np.int64), values[least[moved]].view(np.int64)]), axis=0)
                a.append(pair[1])
                b.append(pair[0])
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return members.select("block", "members").mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE_WORDS, pieces: int = PIECES, distance: int = DISTANCE
) -> DataFrame:
    """``doc_id, fingerprint, component_id, stays, h1, h2``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links of fingerprints that differ in at most
    ``distance`` bits. Null and empty texts, and those without a word, have the fingerprint zero, linked like any other. Null
    ids come last; a group that has no other id has a null component_id. ``stays`` marks the rows of a group with its first
    ``(doc_id, h1, h2)``: one row, or several that are equal in id and text.
    """
    signed = materialize(_signed(docs, width), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    distinct = signed.groupBy("bits").agg(F.min(first).alias("first"))
    groups = components(links(distinct.select("bits"), pieces, distance))
    placed = distinct.join(groups, F.col("bits") == F.col("a"), "left").select("bits", "first", F.coalesce("b", "bits").alias("root"))
    # Groups of one fingerprint need no second look; the others are as many as have a link.
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    by_bits = placed.join(heads, "root").select("bits", "head")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    return signed.join(by_bits, "bits").select(
        "doc_id", "fingerprint", F.col("head.doc_id").alias("component_id"), (own == F.col("head")).alias("stays"), "h1", "h2"
    )


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, pieces: int = PIECES, distance: int = DISTANCE) -> DataFrame:
    """``h1, h2, row``: one row of each group of near-duplicates stays."""
    stays = near_duplicates(docs, width, pieces, distance).where("stays").select("h1", "h2").distinct()
    return B.blocked(docs, 1).join(stays, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("row").alias("row"))
