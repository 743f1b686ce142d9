"""Rows that come back with the same id and the same text are dealt to all blocks, and results stay as they are."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.llm import lines, substrings, suffixes

SCHEMA = "doc_id bigint, text string, block string"
COPIES = 600
LINE = "A line that is repeated with its document, again and again."
REPEATED = "\n".join([LINE, " ".join(f"word{k}" for k in range(300))])


@pytest.fixture
def docs(spark, monkeypatch):
    """600 equal rows, 600 rows without id and text, and 200 rows of their own."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(B, "SHARD_BYTES", 200_000)
    own = [(k, " ".join(f"own{k}of{j}" for j in range(150)), "own") for k in range(200)]
    return spark.createDataFrame([(1000, REPEATED, "x")] * COPIES + [(None, None, None)] * COPIES + own, SCHEMA).repartition(5).cache()


def test_no_block_is_a_group_of_copies(docs):
    blocks = B.parts(B.text_bytes(docs), B.BLOCK_BYTES)
    dealt = B.dealt(docs, blocks)
    held = {r.block: r.rows for r in dealt.groupBy("block").agg(F.count("*").alias("rows")).collect()}
    assert blocks > 20 and sorted(held) == list(range(blocks)) and sum(held.values()) == 2 * COPIES + 200
    assert max(held.values()) < 3 * sum(held.values()) / blocks
    once = sorted(dealt.where("row.doc_id < 1000").select("block", "row.doc_id").collect())
    assert once == sorted(B.blocked(docs, blocks).where("row.doc_id < 1000").select("block", "row.doc_id").collect())
    assert sorted(dealt.where("row.doc_id = 1000").select("block").collect()) == sorted(dealt.where("row.doc_id = 1000").select("block").collect())


def _digests(found, *counts):
    return {tuple(r) for r in found.groupBy("doc_id", *counts, "kept_sha256").count().collect()}


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_lines_of_repeated_rows(docs):
    found = _digests(lines.dedup_lines(docs), "n_lines", "n_dropped")
    # All rows of the largest doc_id that holds a line keep it.
    assert (1000, 2, 0, _sha(REPEATED), COPIES) in found and (None, 1, 0, _sha(""), COPIES) in found and len(found) == 202
    larger = docs.unionByName(docs.where("doc_id = 1000").limit(1).withColumn("doc_id", F.lit(2000).cast("bigint")))
    found = _digests(lines.dedup_lines(larger), "n_lines", "n_dropped")
    assert (1000, 2, 2, _sha(""), COPIES) in found and (2000, 2, 0, _sha(REPEATED), 1) in found


def test_windows_of_repeated_rows(docs):
    found = _digests(substrings.dedup_substrings(docs), "n_words", "n_removed")
    words = len(REPEATED.split())
    assert (1000, words, words, _sha(""), COPIES) in found and (None, 0, 0, _sha(""), COPIES) in found
    assert sum(r[2] for r in found) == words and len(found) == 202


def test_byte_strings_of_repeated_rows(docs):
    found = _digests(suffixes.dedup_byte_strings(docs), "n_bytes", "n_removed", "n_spans")
    size = len(REPEATED)
    assert (1000, size, size, 1, _sha(""), COPIES) in found and (None, 0, 0, 0, _sha(""), COPIES) in found
    assert sum(r[2] for r in found) == size and len(found) == 202
