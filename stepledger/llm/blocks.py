"""Documents in blocks, and packed keys that travel between blocks and shards.

Three operators ask of every piece of text "does it also occur elsewhere?". All work alike. Documents are dealt to
*blocks* of bounded size by a hash of their content. A block sends each *shard* one message: its distinct keys that
belong to the shard, packed into one binary value. A shard sees all blocks that hold a key, decides, and sends one
answer per message back, in the message's order. So

* a key that a third of all documents hold is one entry per block, not one row per document;
* a row that comes back a million times, with one id and one text, is dealt to all blocks in turn, so no block is one group of copies;
* no row of a join is spent on a key, only its 8 or 16 bytes; texts are shuffled by block, once, since all rounds of an
  operator share that exchange;
* every step is a function of a block's or a shard's content alone, so a lost executor's part can be made again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepledger.storage import materialize

#: Text bytes that a block holds on average; a block is one Python group, with some ten times this in memory.
BLOCK_BYTES = 4 << 20
#: Text bytes whose keys a shard holds on average.
SHARD_BYTES = 32 << 20
#: Rows and bytes that a Python worker gets at a time; it holds a few copies of them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def field(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to a size of which a worker can hold several copies."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def packed_rows(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``row``, so that no name of an input column can clash with the operators'."""
    bounded_batches(docs.sparkSession)
    return F.struct(*[field(c) for c in docs.columns]).alias("row")


def documents_of(result: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again, from the struct ``row`` of a result, with another ``text`` if one is given."""
    inner = [F.col("row").getField(c).alias(c) if c != "text" or text is None else text.alias(c) for c in docs.columns]
    return result.select(*inner)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one sum over the text column."""
    return docs.agg(F.sum(F.octet_length(field("text")).cast("bigint"))).first()[0] or 0


def parts(total_bytes: int, each: int) -> int:
    return max(1, math.ceil(total_bytes / each))


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """``(block, h1, h2, row)``: rows of equal doc_id and text share a block and a place in its order."""
    doc_id, text = F.col("row.doc_id").cast("bigint"), F.col("row.text")
    return (
        docs.select(packed_rows(docs))
        .withColumn("h1", F.xxhash64(doc_id, text))
        .withColumn("h2", F.xxhash64(text, F.lit(1), doc_id))
        .select(F.pmod("h1", F.lit(blocks)).cast("int").alias("block"), "h1", "h2", "row")
    )


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """As ``blocked``, but the copies of a row, of one doc_id and one text, are dealt to all blocks in turn.

    Nothing in such rows tells them apart, so their turns are written down once and stay the same for every round and every
    retry. Only rows that have a copy are written; the join that finds them reads hashes of all others.
    """
    placed = blocked(docs, blocks)
    repeats = materialize(placed.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "repeats")
    turn = F.pmod(F.col("block") + F.pmod(F.monotonically_increasing_id(), F.lit(blocks)), F.lit(blocks)).cast("int")
    copies = materialize(placed.join(repeats, ["h1", "h2"], "left_semi").withColumn("block", turn).select(*placed.columns), "copies")
    single = placed.join(repeats, ["h1", "h2"], "left_anti").select(*placed.columns)
    return single.unionByName(copies)


def with_row(ddl: str, placed: DataFrame) -> StructType:
    """The schema of a result: the columns named, and ``row`` as it came."""
    return StructType.fromDDL(ddl).add("row", placed.schema["row"].dataType)


class Block:
    """The documents of one block, in an order that depends on their content only."""

    def __init__(self, table: pa.Table) -> None:
        order = np.lexsort((table["h2"].to_numpy(), table["h1"].to_numpy()))
        self.rows = table["row"].combine_chunks().take(pa.array(order)) if len(order) else table["row"].combine_chunks()
        if isinstance(self.rows, pa.ChunkedArray):
            self.rows = pa.concat_arrays(self.rows.chunks) if self.rows.num_chunks else pa.array([], self.rows.type)
        self.number = table["block"][0].as_py() if table.num_rows else None

    def __len__(self) -> int:
        return len(self.rows)

    def column(self, name: str) -> pa.Array:
        """A field of the rows; a null row has null fields."""
        return self.rows.field(self.rows.type.get_field_index(name))

    def texts(self) -> Iterator[bytes]:
        """The texts as UTF-8 bytes, null as empty."""
        for value in self.column("text").cast(pa.large_binary()):
            yield value.as_py() or b""


def send(block: int, shard_of: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Table:
    """One message per shard: the entries of that shard, in the order in which they stand here."""
    order = np.argsort(shard_of, kind="stable")
    shards, first = np.unique(shard_of[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(first)]
    columns = {"shard": pa.array(shards.astype(np.int32)), "block": pa.array(np.full(len(shards), block, np.int32))}
    for name, values in fields.items():
        placed = values[order]
        columns[name] = pa.array([placed[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
    return pa.table(columns)


def received(answers: pa.Table, name: str, kind: type, shard_of: np.ndarray) -> np.ndarray:
    """The values of a block's answers, one per entry of its messages, in the entries' own order; 0 where none came."""
    order = np.argsort(shard_of, kind="stable")
    shards, first = np.unique(shard_of[order], return_index=True)
    ends = dict(zip(shards.tolist(), zip(first, np.append(first[1:], len(order))[: len(first)], strict=True), strict=True))
    out = np.zeros(len(shard_of), kind)
    for shard, value in zip(answers["shard"].to_pylist(), answers[name].to_pylist(), strict=True):
        a, b = ends[shard]
        out[order[a:b]] = np.frombuffer(value, kind)
    return out


def joined(messages: pa.Table, name: str, kind: type) -> np.ndarray:
    """One field of all messages of a shard, end to end."""
    return np.frombuffer(b"".join(messages[name].to_pylist()), kind)


def cut(messages: pa.Table, values: np.ndarray, name: str, width: int, like: str) -> pa.Table:
    """Answers ``(block, shard, name)``: ``values`` cut as the field ``like`` (of ``width`` bytes an entry) is."""
    sizes = np.array([len(x) // width for x in messages[like].to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "block": messages["block"].combine_chunks(),
            "shard": messages["shard"].combine_chunks(),
            name: pa.array([values[b - n : b].tobytes() for n, b in zip(sizes, ends, strict=True)], pa.binary()),
        }
    )


def repeated(first: np.ndarray, second: np.ndarray | None, several: np.ndarray) -> np.ndarray:
    """Which entries have an equal entry, or stand for several already."""
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    same = first[order][1:] == first[order][:-1]
    if second is not None:
        same &= second[order][1:] == second[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    weight = np.bincount(group, weights=several[order].astype(np.float64) + 1)
    out = np.zeros(len(first), bool)
    out[order] = weight[group] > 1
    return out


def per_block(docs: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("block").applyInArrow(work, schema)


def per_shard(messages: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return messages.groupBy("shard").applyInArrow(work, schema)


def with_answers(docs: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``work(block's documents, block's answers)`` for every block."""
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)
