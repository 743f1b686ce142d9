"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

``N(g)`` is the number of open sequences with residual gap ``g``. A document goes where the sum of all ``N(g)²`` becomes
smallest: into some open sequence whose gap it fits, or into a new one. That keeps gaps of all sizes in stock, so that
most sequences end up full. The few documents whose sequences are not full in the end are taken out and placed once more,
longest first, each where it leaves the least room.

Only lengths are packed. They are dealt to groups of bounded size by a hash; a group's few unfilled sequences are all
that is lost against packing everything in one place.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.llm.tokens import RANKS, VOCABULARY, encoder

CAPACITY = 2048
#: Documents whose last lengths one group packs, on average.
GROUP_ROWS = 200_000


def _place(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The sequences as lists of positions in ``lengths``; all lengths are below the capacity."""
    stock = np.zeros(capacity + 1, np.int64)  # N(g); the gap 0 is closed and counts nothing
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences: list[list[int]] = []
    never = np.iinfo(np.int64).max
    for position, length in enumerate(lengths.tolist()):
        gaps, left = stock[length:capacity], stock[: capacity - length]
        # Moving a sequence from gap g to g - length changes the sum by 2 N(g - length) - 2 N(g) + 2, closing it by 1 - 2 N(g).
        change = np.where(gaps > 0, 2 * (left - gaps) + 2, never)
        if gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin())
        if change[best] <= 2 * stock[capacity - length] + 1:
            gap = length + best
            sequence = with_gap[gap].pop()
            stock[gap] -= 1
        else:
            gap, sequence = capacity, len(sequences)
            sequences.append([])
        sequences[sequence].append(position)
        if gap > length:
            with_gap[gap - length].append(sequence)
            stock[gap - length] += 1
    return sequences


def _best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The sequences for lengths that fall: each goes to the fullest sequence that has room for it."""
    gaps: list[tuple[int, int]] = []  # (gap, sequence), ascending
    sequences: list[list[int]] = []
    for position, length in enumerate(lengths.tolist()):
        at = bisect.bisect_left(gaps, (length, -1))
        if at < len(gaps):
            gap, sequence = gaps.pop(at)
        else:
            gap, sequence = capacity, len(sequences)
            sequences.append([])
        sequences[sequence].append(position)
        if gap > length:
            bisect.insort(gaps, (gap - length, sequence))
    return sequences


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences for lengths in the order given; whole sequences stand alone."""
    whole = [[int(i)] for i in np.flatnonzero(lengths >= capacity)]
    rest = np.flatnonzero(lengths < capacity)
    placed = [[int(rest[i]) for i in s] for s in _place(lengths[rest], capacity)]
    full = [s for s in placed if lengths[s].sum() == capacity]
    loose = [s for s in placed if lengths[s].sum() < capacity]
    again = np.array(sorted((i for s in loose for i in s), key=lambda i: -lengths[i]), np.int64)
    better = [[int(again[i]) for i in s] for s in _best_fit(lengths[again], capacity)]
    return whole + full + (better if len(better) < len(loose) else loose)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids and a final 0, cut if longer than a sequence.

    All pieces but the first have the full length. A null text is empty: its one piece is the final 0.
    """

    @F.pandas_udf("struct<n_ids: bigint, crcs: array<bigint>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary, ranks)
        for texts in batches:
            sizes, crcs = [], []
            for text in texts:
                ids = np.append(own.ids(text or ""), 0).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                sizes.append(len(ids))
                crcs.append([zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
            yield pd.DataFrame({"n_ids": sizes, "crcs": crcs})

    B.bounded_batches(docs.sparkSession)
    found = docs.select(B.field("doc_id").cast("bigint").alias("doc_id"), cut(B.field("text")).alias("found"))
    first = F.col("n_ids") - (F.size("crcs") - 1) * F.lit(capacity).cast("bigint")
    # No row is without a piece, so the outer form gives the same; the other one adds a filter, for which all is encoded twice.
    return (
        found.select("doc_id", "found.n_ids", "found.crcs")
        .select("doc_id", first.alias("first"), F.posexplode_outer("crcs").alias("piece", "ids_crc32"))
        .select(
            "doc_id",
            "piece",
            F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("bigint").alias("start"),
            F.when(F.col("piece") == 0, F.col("first")).otherwise(capacity).cast("bigint").alias("length"),
            "ids_crc32",
        )
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    ranks: str | None = RANKS,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: the place of every piece of every row.

    Rows with equal ids are packed each. Sequence ids are unique, not gapless.
    """
    groups = B.parts(docs.count(), group_rows)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = pieces(docs, vocabulary, ranks, capacity).withColumn("mixed", F.xxhash64(*columns))
    dealt = dealt.withColumn("pack", F.pmod("mixed", F.lit(groups)).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["start"].to_numpy(), table["mixed"].to_numpy()))
        table = table.take(pa.array(order))
        lengths = table["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, members in enumerate(pack(lengths, capacity)):
            sequence[members] = number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        sequence += table["pack"][0].as_py() << 32
        out = table.select(columns)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("pack").applyInArrow(packed, schema)
