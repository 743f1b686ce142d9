"""Quality rules: counts, and divergence of a document's histograms from its language's.

Two histograms are compared with references by the Jensen-Shannon distance (base 2, so 0 to 1): classes of
characters, and some of the most common words of each language with all other words as one class. The reference of a language is the
sum over its documents that pass the base rules and have few symbols; documents without a language are compared with the sum over all. A
histogram of few characters or words says little, so below a minimum length it is not judged.

Built-in expressions only. The counts are computed once and written to the shared folder, as the references need them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.storage import materialize

# Frequent function words of the languages looked for.
COMMON_WORDS = (
    "the of and to in is that it for with "
    "der die das und ist zu den von mit ein "
    "le la les des et un une est que dans "
    "el los las del se no por para con es"
).split()

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Largest distance that is kept, and least length that is judged, for characters and for words.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.2, 200
MAX_WORD_DISTANCE, MIN_JUDGED_WORDS = 0.45, 100

_NOT_CLASS = [r"\P{Lu}+", r"\P{Ll}+", r"\P{N}+"]
PUNCTUATION = ".,;:!?'\"()-"
_N_CLASSES = len(_NOT_CLASS) + 3
_N_WORDS = len(COMMON_WORDS) + 1


def _split(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _at(array: Column, position: Column) -> Column:
    return F.get(array, position)


def _is(word: str):
    return lambda w: w == word


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words that lie in a window of three words found twice or more in the text.

    Windows are sorted by their 64-bit hash and their place, so equal ones are neighbours, in texts of any length.
    """
    words = F.col("words")
    keyed = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, _at(words, i + 1), _at(words, i + 2)).alias("hash"), i.alias("at")),
    )
    df = df.withColumn("sorted", F.sort_array(keyed))
    near = F.col("sorted")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(x["hash"] == _at(near, i)["hash"], F.lit(False))

    found = F.filter(near, lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))
    df = df.withColumn("places", F.sort_array(F.transform(found, lambda x: x["at"])))
    places = F.col("places")
    # A place counts its window's words up to the next place; the last one counts all three.
    nexts, but_last = F.slice(places, F.lit(2), F.size(places)), F.slice(places, F.lit(1), F.size(places) - 1)
    steps = F.zip_with(nexts, but_last, lambda b, a: F.least(b - a, F.lit(3)))
    total = F.aggregate(steps, F.lit(3).cast("bigint"), lambda so_far, x: so_far + x)
    return df.withColumn("n_repeat_words", F.when(F.size(places) == 0, F.lit(0)).otherwise(total).cast("bigint"))


def counts(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, lang, h1, h2``, the counts of the base rules, ``base_failed``, and the two histograms."""
    text = F.col("text")
    keyed = B.blocked(docs, 1).select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        F.col("row.lang").alias("lang"),
        "h1",
        "h2",
        F.coalesce(F.col("row.text"), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = (
        keyed.withColumn("words", _split(text))
        .withColumn("lines", lines)
        .withColumn("tokens", F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: w != ""))
        .withColumn("common", F.filter("tokens", lambda w: w.isin(COMMON_WORDS)))
        .withColumn("n_words", F.size("words").cast("bigint"))
    )
    length = F.length(text)
    classes = [F.length(F.regexp_replace(text, pattern, "")) for pattern in _NOT_CLASS]
    classes += [length - F.length(F.translate(text, few, "")) for few in (SPACES, PUNCTUATION)]
    words = [F.size(F.filter("common", _is(v))) for v in COMMON_WORDS]
    counted = _with_repeats(split).select(
        "doc_id",
        "lang",
        "h1",
        "h2",
        "n_words",
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        length.cast("bigint").alias("n_chars"),
        F.array(*classes).cast("array<bigint>").alias("classes"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array(*words).cast("array<bigint>").alias("words"),
    )

    def rest(total: str, parts: str) -> Column:
        return F.concat(F.col(parts), F.array(F.col(total) - F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (
        counted.withColumn("classes", rest("n_chars", "classes"))
        .withColumn("words", rest("n_tokens", "words"))
        .withColumn("base_failed", failed)
    )


def references(counted: DataFrame) -> DataFrame:
    """``lang, class_sums, word_sums``: a row per language, and one with an empty name for all together."""

    def sums(name: str, n: int) -> Column:
        return F.array(*[F.sum(_at(F.col(name), F.lit(k))) for k in range(n)])

    good = counted.where((~F.col("base_failed")) & (10 * F.col("n_symbols") <= F.col("n_words")))
    named = good.where(F.coalesce("lang", F.lit("")) != "").select("lang", "classes", "words")
    groups = named.union(good.select(F.lit("").alias("lang"), "classes", "words")).groupBy("lang")
    return groups.agg(sums("classes", _N_CLASSES).alias("class_sums"), sums("words", _N_WORDS).alias("word_sums"))


def jensen_shannon(own: Column, other: Column) -> Column:
    """Distance of two histograms of counts; null where one of them is empty."""

    def shares(counts_: Column) -> Column:
        total = F.aggregate(counts_, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(counts_, lambda x: x / total))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(shares(own), shares(other), lambda p, q: part(p, q) + part(q, p))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(total)).otherwise(total * 0)  # rounding may leave a little less than 0


def quality_rules(
    docs: DataFrame, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE
) -> DataFrame:
    """Per row of ``docs``: the counts, both distances, ``base_failed`` and ``kept``, and ``h1, h2`` for id and text.

    A null text has no words and fails the base rules, as an empty one does. Without any document that passes them there
    is no reference, and no distance. Rows with equal ids are judged each.
    """
    counted = materialize(counts(docs), "counts")
    known = materialize(references(counted), "references")  # a row per language; its size on disk plans the join
    by_name = known.select(F.col("lang").alias("name"), "class_sums", "word_sums")
    names = known.select(F.col("lang").alias("named"))
    own = counted.join(names, F.col("lang") == F.col("named"), "left").withColumn("name", F.coalesce("named", F.lit("")))
    judged = (
        own.join(by_name, "name", "left")
        .withColumn("char_distance", F.when(F.col("n_chars") >= MIN_CHARS, jensen_shannon(_doubles("classes"), _doubles("class_sums"))))
        .withColumn("word_distance", F.when(F.col("n_words") >= MIN_JUDGED_WORDS, jensen_shannon(_doubles("words"), _doubles("word_sums"))))
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "char_distance",
        "word_distance",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        "h1",
        "h2",
    )


def _doubles(name: str) -> Column:
    return F.col(name).cast("array<double>")
