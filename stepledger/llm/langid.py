"""Language identification by compression.

Each language has a dictionary of raw text, lower-cased like the texts. A text is compressed with every language's dictionary, in blocks so that the
dictionary and not the text's own beginning is what helps, and belongs to the language that gives the fewest bytes. Where the
second best is nearly as short, the text is rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B

UNKNOWN = "und"
#: A dictionary is made of so many windows of so many characters, one of each of as many equal shares of the texts.
WINDOWS, WINDOW_CHARS = 512, 256
BLOCK_CHARS = 1024
#: Share of the second best size by which the best must be smaller.
NARROW = 0.005
#: Sizes are whole bytes, so shorter texts have no margin to speak of and are not rejected for it.
MIN_JUDGED_CHARS = 64
_LEVEL = 9


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def window(text: Column, chars: int) -> Column:
    """A stretch of a text at a place that its hash gives."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(F.lit(3), text), room) + 1).cast("int"), F.lit(chars))


def dictionaries(labelled: DataFrame, windows: int = WINDOWS, chars: int = WINDOW_CHARS) -> dict[str, bytes]:
    """Raw dictionary by language, from ``(text, lang)``; rows with a null in either are left out.

    Texts are dealt to ``windows`` shares by their hash; of each share and language the text with the smallest other hash
    gives one window. So the sample is bounded by languages × windows × chars, and copies of a text count once.
    """
    text, lang = B.field("text"), B.field("lang")
    share = F.pmod(F.xxhash64(text), F.lit(windows))
    rows = labelled.where(text.isNotNull() & lang.isNotNull()).select(
        lang.alias("lang"), share.alias("share"), window(text, chars).alias("window"), F.xxhash64(text, F.lit(5)).alias("rank")
    )
    best = rows.groupBy("lang", "share").agg(F.min(F.struct("rank", "window")).getField("window").alias("window"))
    found: dict[str, list[str]] = {}
    for lang, piece in best.orderBy("lang", "share").select("lang", "window").toLocalIterator():
        found.setdefault(lang, []).append(piece)
    return {lang: "\n".join(pieces).lower().encode() for lang, pieces in found.items()}


@functools.lru_cache(maxsize=2)
def _compressors(languages: tuple[tuple[str, bytes], ...]) -> list[tuple[str, object]]:
    import zstandard as zstd

    out = []
    for lang, raw in languages:
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=_LEVEL)
        out.append((lang, zstd.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False)))
    return out


def judge(text: str, compressors: list[tuple[str, object]], narrow: float) -> tuple[str, float]:
    """The language and a score: half at the margin ``narrow``, towards 1 the wider it is."""
    if not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    text = text.lower()
    parts = [text[a : a + BLOCK_CHARS].encode() for a in range(0, len(text), BLOCK_CHARS)]
    sizes = sorted((sum(len(c.compress(x)) for x in parts), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    margin = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], margin / (margin + narrow)


def identify(docs: DataFrame, learned: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """``doc_id, lang_pred, score, rejected, row`` for every row of ``docs``.

    ``lang_pred`` is ``und``, with score 0, where the text is null or has no letter (or no language was learned); these
    are rejected, and so are texts of at least MIN_JUDGED_CHARS characters with a narrow margin. With one learned language there is no second, and the score is 1. Ties
    go to the language that sorts first.
    """
    languages = tuple(sorted(learned.items()))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(languages)
        for texts in batches:
            found = [judge(x or "", compressors, narrow) for x in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"]).astype({"lang_pred": str, "score": float})

    found = docs.select(B.packed_rows(docs)).select("row", judged(F.col("row.text")).alias("found"))
    narrow_margin = (F.col("found.score") < 0.5) & (F.length("row.text") >= MIN_JUDGED_CHARS)
    return found.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        "found.lang_pred",
        "found.score",
        ((F.col("found.lang_pred") == UNKNOWN) | narrow_margin).alias("rejected"),
        "row",
    )


def learn_and_identify(docs: DataFrame, folds: int = 5, narrow: float = NARROW) -> DataFrame:
    """``identify`` with dictionaries from the labelled rows outside fold 0, and a column ``held_out`` for fold 0.

    A row with a null id belongs to no fold: it is not learned from and not held out.
    """
    learned = dictionaries(docs.where(remainder(B.field("doc_id"), folds) != 0))
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return identify(docs, learned, narrow).withColumn("held_out", held_out)
