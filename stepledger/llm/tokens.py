"""Token counts and ids of whole texts, of any length.

A text may be cut before a white-space character that follows another character: the tokenizers' splitting patterns
never join across such a place, and never look back beyond it, so the parts' ids are the whole's ids (a *stable* boundary).

Huge texts are encoded in overlapping chunks with offsets. The chunks are spliced at a boundary in the overlap that is a
token start in both encodings and stable. Where there is none, the overlap is widened, in the end to the whole text. So
the encodings held at a time stay small, and no text is cut where the ids would change. Other texts are encoded at once.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B

#: Longer texts (in characters) are encoded in chunks of so many characters that overlap by so many.
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 512
#: The vocabulary, and the same as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare name is a file of the installed public tokenizers."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def is_stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n\t\r" and not text[at - 1].isspace()


def splice(text: str, encode, chunk: int, overlap: int) -> np.ndarray:
    """The ids of a text from overlapping chunks; ``encode`` gives ids and the character at which each token begins."""
    out, start = [], 0
    base, size = 0, chunk + overlap
    ids, begins = encode(text[:size])
    end = min(size, len(text))
    while end < len(text):
        after = end - overlap
        next_end = min(after + chunk + overlap, len(text))
        next_ids, next_begins = encode(text[after:next_end])
        # A character of several tokens begins several; only its first one is a boundary, which unique positions give.
        both = np.intersect1d(begins + base, next_begins + after)
        common = next((int(p) for p in both if p > max(start, after) and is_stable(text, int(p))), None)
        if common is None:  # widen: a longer left chunk, of which more overlaps
            size, overlap = size * 2, overlap * 2
            base, end = start, min(start + size, len(text))
            ids, begins = encode(text[base:end])
            continue
        out.append(ids[np.searchsorted(begins + base, start) : np.searchsorted(begins + base, common)])
        ids, begins, base, end, start = next_ids, next_begins, after, next_end, common
    out.append(ids[np.searchsorted(begins + base, start) :])
    return np.concatenate(out)


class Encoder:
    """Ids as the ``tokenizers`` library gives them, without added special tokens.

    ``ranks`` may name the same vocabulary as ranks of byte pieces. Texts without characters beyond the Latin blocks, whose
    classes all versions of the splitting pattern agree on, are then encoded by ``tiktoken``, which is faster.
    """

    def __init__(self, path: str, ranks: str | None = None, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self._path = path
        self._huge, self._chunk, self._overlap = huge, chunk, overlap
        self._ranks = self._by_ranks(ranks) if ranks else None

    @functools.cached_property
    def _tokenizer(self):
        """Made when a text first needs it, as it is large."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self._path)
        found.no_truncation()
        found.no_padding()
        return found

    def _by_ranks(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(self._path, encoding="utf-8") as vocabulary:
            special = {x["content"]: x["id"] for x in json.load(vocabulary)["added_tokens"]}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self._tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.array([a for a, _ in found.offsets], np.int64)

    def ids(self, text: str) -> np.ndarray:
        if len(text) > self._huge:
            return splice(text, self.with_offsets, self._chunk, self._overlap)
        if self._ranks is not None and not _BEYOND_LATIN.search(text):
            return self._ranks.encode_to_numpy(text, allowed_special="all")
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    """One per Python worker, which keeps it from task to task."""
    return Encoder(vocabulary_path(vocabulary), vocabulary_path(ranks) if ranks else None)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, row``; a null text is empty and has no tokens."""

    @F.pandas_udf("struct<n_bytes: bigint, n_tokens: bigint>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary, ranks)
        for texts in batches:
            whole = ["" if x is None else x for x in texts]
            sizes = {"n_bytes": [len(x.encode()) for x in whole], "n_tokens": [len(own.ids(x)) for x in whole]}
            yield pd.DataFrame(sizes, dtype="int64")

    rows = docs.select(B.packed_rows(docs))
    found = rows.select("row", counted(F.col("row.text")).alias("found"))
    return found.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        "found.n_bytes",
        "found.n_tokens",
        (F.col("found.n_tokens") > limit).alias("over_limit"),
        "row",
    )
