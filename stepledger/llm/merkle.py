"""A Merkle manifest of a dataset: one root for all rows, and for every row a witness that it belongs to it.

The witnesses grow while the tree does. Nodes are appended in order; a run of ``arity`` nodes that is complete becomes
their parent, and each of them, with all that lies below it, gets its siblings as the next part of its witness. Until then
the subtree is open and its witness partial.

The rows of a key (a language) are numbered by a range partitioning and cut into aligned blocks of ``arity ** levels``. A
task appends the nodes of one block and hands up the block's root, which is just one more append a storey higher; thirty
billion rows need three storeys until one node per key is left. These subroots are the nodes of one last tree. On
the way back every block learns the witness of its own root, by which it extends those of its nodes. So no task holds
more than a block, whatever share of the rows a key has, and what travels is a digest per row and one witness per block: a
block's nodes are appended a second time instead of writing their partial witnesses down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.llm.blocks import bounded_batches, field
from stepledger.scale import number_rows
from stepledger.storage import materialize

ARITY = 8
#: A block holds ``ARITY ** LEVELS`` nodes: 4096, of 32 bytes each.
LEVELS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- one tree, on one machine ----


def joined_hash(digests: list[bytes]) -> bytes:
    """H of digests as hex text."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def height(n: int, arity: int = ARITY) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _part(place: int, siblings: list[bytes]) -> bytes:
    """One level of a witness: the place among the siblings, their number, and they, left to right."""
    return bytes((place, len(siblings))) + b"".join(siblings)


def parts(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Level by level upwards: the place, and the siblings."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        at += 2
        yield place, [witness[at + 32 * k : at + 32 * (k + 1)] for k in range(n)]
        at += 32 * n


def proof_hash(witness: bytes) -> bytes:
    """H of all siblings of a witness."""
    return joined_hash([s for _, siblings in parts(witness) for s in siblings])


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and a witness give."""
    for place, siblings in parts(witness):
        digest = joined_hash([*siblings[:place], digest, *siblings[place:]])
    return digest


class Appender:
    """A tree that takes nodes one by one and extends the witnesses of what each of them completes."""

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.digests: list[bytes] = []
        #: Per node its part of the witness and its parent, None while its run is open.
        self.above: list[tuple[bytes, int] | None] = []
        #: Per level the nodes of the open run.
        self.open: list[list[int]] = [[]]

    def append(self, digest: bytes, level: int = 0) -> int:
        node = len(self.digests)
        self.digests.append(digest)
        self.above.append(None)
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.arity:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [self.digests[n] for n in run]
        parent = len(self.digests)  # the number that append gives it
        for place, node in enumerate(run):
            self.above[node] = (_part(place, digests[:place] + digests[place + 1 :]), parent)
        self.append(joined_hash(digests), level + 1)

    def close(self, height: int) -> bytes:
        """Complete the open runs below ``height``, however short; the node that is left there."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.digests[self.open[height][0]]

    def witnesses(self) -> list[bytes]:
        """Of every node, what is known of its witness so far; parents come after their children."""
        out: list[bytes] = [b""] * len(self.digests)
        for node in range(len(self.digests) - 1, -1, -1):
            if self.above[node]:
                own, parent = self.above[node]
                out[node] = own + out[parent]
        return out


def _block_tree(digests: list[bytes], total: int, levels: int, arity: int) -> tuple[list[int], Appender, bytes]:
    """The nodes of one block of a key with ``total`` nodes, and the block's root; a key of one block is no higher than it must."""
    tree = Appender(arity)
    nodes = [tree.append(d) for d in digests]
    return nodes, tree, tree.close(levels if total > arity**levels else height(total, arity))


# ---- trees of any size ----

_NODE = "tree string, position bigint, digest binary, total bigint"
_PLACE = "tree string, block bigint, witness binary, subroot binary, root binary"


def _in_blocks(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"position div {arity**levels}L")).groupBy("tree", "block")


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table["position"]))


def _block_roots(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    def root(table: pa.Table) -> pa.Table:
        table, total = _ordered(table), table["total"][0].as_py()
        digest = _block_tree(table["digest"].to_pylist(), total, levels, arity)[2]
        above = {"digest": pa.array([digest], pa.binary()), "total": pa.array([-(-total // arity**levels)], pa.int64())}
        return pa.table({"tree": table["tree"].slice(0, 1), "position": table["block"].slice(0, 1), **above})

    return _in_blocks(nodes, levels, arity).applyInArrow(root, _NODE)


def storeys(nodes: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> list[DataFrame]:
    """``nodes`` and, storey by storey, the roots of their blocks, until every tree has one node; the driver sees one number each."""
    found = [nodes]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > 1:
        found.append(materialize(_block_roots(found[-1], levels, arity), "storey"))
    return found


def _extend(nodes: DataFrame, above: DataFrame, levels: int, arity: int, keep: str = "") -> DataFrame:
    """The whole witnesses of ``nodes``, from those of the roots of their blocks; ``keep`` names further columns, as DDL."""

    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table)
        total = table["total"][0].as_py()
        nodes, tree, _ = _block_tree(table["digest"].to_pylist(), total, levels, arity)
        rest, own = answers["witness"][0].as_py(), tree.witnesses()
        every = np.zeros(len(nodes), np.int64)
        out = {
            "tree": table["tree"],
            "block": table["position"],
            "witness": pa.array([own[n] + rest for n in nodes], pa.binary()),
            "subroot": answers["subroot"].take(every),
            "root": answers["root"].take(every),
        }
        return pa.table(out | {name: table[name] for name in kept})

    kept = [part.split()[0] for part in keep.split(",")] if keep else []
    schema = f"{_PLACE}, {keep}" if keep else _PLACE
    return _in_blocks(nodes, levels, arity).cogroup(above.groupBy("tree", "block")).applyInArrow(work, schema)


def manifest(leaves: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """``doc_id, digest, claim, tree, position, witness, subroot, root`` of ``leaves (tree, doc_id, digest, claim)``, a row each.

    A tree is one key. Its leaves ascend by doc_id (null first), equal ones by digest, so that rows in any order and
    partitioning give the same roots. The subroots, by key, are the leaves of the last tree. ``claim``, a second digest, only
    travels along.
    """
    leaves = materialize(leaves.select("tree", "doc_id", "digest", "claim"), "leaves")
    totals = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    placed = materialize(number_rows(leaves, ["tree"], ["doc_id", "digest"], "position").join(totals, "tree"), "leaves")
    forest = storeys(placed.select("tree", "position", "digest", "total"), levels, arity)
    subroots = forest[-1].select(F.col("tree").alias("key"), "digest")
    total = F.lit(subroots.count()).cast("bigint")
    top = number_rows(subroots, [], ["key"], "position").select(F.lit("").alias("tree"), "position", "digest", total.alias("total"), "key")
    top = materialize(top, "subroots")
    summit = storeys(top.select("tree", "position", "digest", "total"), levels, arity)
    # Downwards: from the root to the subroots, and from those to the leaves.
    nothing = F.lit(b"")
    above = summit[-1].select("tree", F.lit(0).cast("bigint").alias("block"), nothing.alias("witness"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(summit[:-1]):
        above = _extend(nodes, above, levels, arity)
    above = above.join(top, F.col("block") == F.col("position")).select(
        F.col("key").alias("tree"), F.lit(0).cast("bigint").alias("block"), "witness", F.col("digest").alias("subroot"), "root"
    )
    for nodes in reversed(forest[1:-1]):
        above = _extend(nodes, above, levels, arity)
    return _extend(placed, above, levels, arity, "doc_id bigint, digest binary, claim binary").withColumnRenamed("block", "position")


# ---- documents ----


def _field_text(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256 over values, each ``-`` if null, else its UTF-8 byte count, a colon and itself; as bytes."""
    return F.unhex(F.sha2(F.concat(*[_field_text(v) for v in values]).cast("binary"), 256))


def document_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """The manifest of documents, with ``verified``: does the row as it is now still fold to the root?

    A leaf is ``doc_id, source, lang, n_chars, text``; every other column stays out. The languages are the keys, null the first.
    ``changed`` is the text as someone found it later (default: as it is). Returns ``doc_id, leaf, subroot, root,
    proof_sha256, folded_root`` in hex, ``verified`` and the binary ``witness``. Null, empty and very long values are
    values like others; equal rows are leaves of their own. An empty table gives no row.
    """
    bounded_batches(docs.sparkSession)
    values = [field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    own = leaf(*values)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), field("lang")), F.lit("")).alias("tree"),
        field("doc_id").cast("bigint").alias("doc_id"),
        own.alias("digest"),
        (own if changed is None else leaf(*values[:-1], changed)).alias("claim"),
    )

    @F.pandas_udf("struct<proof: binary, folded: binary>")
    def folded(claims: pd.Series, witnesses: pd.Series) -> pd.DataFrame:
        found = [(proof_hash(w), fold(c, w)) for c, w in zip(claims, witnesses, strict=True)]
        return pd.DataFrame(found, columns=["proof", "folded"])

    def hex_of(name: str) -> Column:
        return F.lower(F.hex(name))

    return manifest(leaves).withColumn("of", folded("claim", "witness")).select(
        "doc_id",
        hex_of("digest").alias("leaf"),
        hex_of("subroot").alias("subroot"),
        hex_of("root").alias("root"),
        hex_of("of.proof").alias("proof_sha256"),
        hex_of("of.folded").alias("folded_root"),
        (F.col("of.folded") == F.col("root")).alias("verified"),
        "witness",
    )


def lower_cased(docs: DataFrame, every: int = 3) -> Column:
    """The tampering of the check: A-Z of the text lower-cased where ``every`` divides crc32 of the decimal doc_id."""
    text = field("text")
    hit = F.crc32(field("doc_id").cast("bigint").cast("string").cast("binary")) % every == 0
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)
