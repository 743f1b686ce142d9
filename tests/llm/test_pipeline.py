"""The pipeline's stages on small tables: what goes, what stays, and in which columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stepledger.llm import langid, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "block", "row"]
ITEM = "this passage of a benchmark must not be learned by heart from any document at all"


def _tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("own")).withColumn("row", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    of = {"en": ["the", "and", "ing", "wh", "tion"], "es": ["ción", "ñe", "el", "que", "lla"]}

    def text(lang: str, n: int) -> str:
        return " ".join("".join(rng.choices(of[lang], k=rng.randint(1, 3))) for _ in range(n))

    line = "a line which stands in many of the documents of this table"
    out = [(k, text(lang := rng.choice(["en", "es"]), 120) + (f"\n{line}" if k % 2 else ""), lang, "s", 1) for k in range(1, 13)]
    out += [(20, out[0][1], "en", "s", 1), (0, out[3][1], "en", "s", 1), (21, text("en", 90) + " " + ITEM.upper(), "en", "s", 1)]
    out += [(22, "123 456", "en", "s", 7), (23, None, None, None, None), (24, "", "en", "s", 0), (None, text("en", 100), None, "s", 1), (25, text("es", 3000), "es", "s", 1)]
    return [*out, out[-1]]


def test_stages(spark, tmp_path, rows):
    docs = _tables(spark, tmp_path, rows)
    stages = dict(P.STAGES)
    assert [name for name, _ in P.STAGES] == ["language", "lines", "near_copies", "benchmark", "packing"] and P.ORACLE_SQL is None

    def step(name, before):
        path = f"{tmp_path}/{name}"
        stages[name](spark, before, str(tmp_path)).write.parquet(path)
        return spark.read.parquet(path)

    spoken = step("language", docs)
    assert spoken.columns == COLUMNS
    kept = spoken.collect()
    assert not [r for r in kept if not any(c.isalpha() for c in r.text or "")]
    judged = langid.learn_and_identify(docs).where("NOT rejected")
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in judged.select("doc_id").collect())

    lined = step("lines", spoken)
    line = "a line which stands"
    assert lined.columns == COLUMNS and lined.count() == len(kept)
    holders = [r.doc_id for r in lined.collect() if line in r.text]
    assert holders == [max(r.doc_id for r in kept if r.doc_id is not None and line in r.text)]
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = step("near_copies", lined)
    prints = {}
    for r in lined.collect():
        prints.setdefault(simhash.fingerprint(r.text.encode()), []).append(r.doc_id)
    left = single.collect()
    assert single.columns == COLUMNS and len(left) == len(prints)
    assert all(any(r.doc_id in ids for r in left) for ids in prints.values())

    clean = step("benchmark", single)
    assert clean.columns == COLUMNS
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in left if r.doc_id != 21)

    packed = step("packing", clean).toPandas()
    assert packed.doc_id.nunique() == clean.where("doc_id IS NOT NULL").count()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_run_over_nothing_and_over_one_row(spark, tmp_path):
    _tables(spark, tmp_path / "none", [])
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    _tables(spark, tmp_path / "one", [(5, "only a few words are here", "en", "s", 25)])
    assert [r.doc_id for r in P.run(spark, str(tmp_path / "one")).collect()] == [5]


def test_run_over_the_test_table(spark):
    found = P.run(spark, "/root/testdata/sf0.001").toPandas()
    sizes = found.groupby("sequence_id").length.sum()
    assert len(found) and sizes.max() <= 2048
    ends = found.sort_values(["sequence_id", "offset"])
    assert np.array_equal(ends.offset, ends.groupby("sequence_id").length.cumsum() - ends.length)
