"""Every operator of the training-text package against a plain version of its definition, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stepledger.llm import blocks as B
from stepledger.llm import decontamination, langid, lines, packing, quality, rules, simhash, substrings, suffixes, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHING = ["block", "shard", "row", "h1", "h2", "score", "n_words", "found", "hits", "bits", "a", "b", "piece", "share"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus() -> list[tuple]:
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "re", "tu", "né", "ß", "sho", "ven"]

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))

    passage, line = words(60), "A line that many documents hold, with more than forty characters."
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n\x0b ", "en", None, 5),
        (4, "123 456", None, "s", 7),
        (None, words(80) + "\n" + line, "en", "s", None),
        (None, None, "en", "s", None),
        (5, passage, "en", "s", 1),
        (6, passage, "en", "s", 1),
        (6, passage, "en", "s", 1),
        (7, words(30) + "\n" + passage + "\n" + words(30), "de", "s", 1),
        (8, words(20) + "\x00  " + passage.replace(" ", "\n"), "de", "s", 1),
        (9, (words(9) + "\n") * 40, "fr", "s", 1),
        (10, words(6000), "fr", "s", 1),
        (11, "x" * 3000, "fr", "s", 1),
        (12, "the same " * 300, "en", "s", 1),
    ]
    # Words that no polynomial modulo a power of two tells apart, after 34 equal ones.
    morse = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    shared = words(34)
    rows += [(30, f"{shared} {morse}", "en", "s", 1), (31, f"{shared} {morse.translate(str.maketrans('ab', 'ba'))}", "en", "s", 1)]
    for k in range(13, 21):
        text = words(rng.randint(1, 120)) + ("\n  " + line.upper() + " \r\n" + words(3) if k % 2 else "")
        rows.append((k, text, rng.choice(["en", "de"]), "s", len(text)))
    return rows + [rows[-1], (rows[-1][0], "other text with the same id", "en", "s", 1)]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _as_set(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _covered(n: int, starts, width: int) -> list[bool]:
    out = [False] * n
    for s in starts:
        out[s : s + width] = [True] * width
    return out


def test_lines(docs, rows, nothing):
    space = b" \t\n\x0b\x0c\r"
    holders: dict[bytes, list] = {}
    for doc_id, text, *_ in rows:
        for key in {x.strip(space).lower() for x in (text or "").encode().split(b"\n")}:
            holders.setdefault(key, []).append(-(2**63) if doc_id is None else doc_id)
    expected = Counter()
    for doc_id, text, *_ in rows:
        own, kept = -(2**63) if doc_id is None else doc_id, []
        parts = (text or "").encode().split(b"\n")
        for x in parts:
            key = x.strip(space).lower()
            if len(key.decode()) < 40 or len(holders[key]) < 5 or max(holders[key]) == own:
                kept.append(x)
        expected[(doc_id, len(parts), len(parts) - len(kept), _sha(b"\n".join(kept)))] += 1
    assert any(n[2] for n in expected)
    found = lines.dedup_lines(docs)
    assert _as_set(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected
    assert B.documents_of(found, docs).columns == docs.columns
    assert lines.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("sizes", [(8 << 20, 32 << 20), (4000, 2000)])
def test_substrings(docs, rows, nothing, sizes, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(B, "SHARD_BYTES", sizes[1])
    texts = [WORD.findall(t or "") for _, t, *_ in rows]
    times = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    expected = Counter()
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        gone = _covered(len(w), [i for i in range(len(w) - 34) if times[tuple(w[i : i + 35])] > 1], 35)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[(doc_id, len(w), sum(gone), _sha(kept.encode()))] += 1
    assert _as_set(substrings.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert substrings.dedup_substrings(nothing).count() == 0


def test_difference_cover():
    assert substrings.is_cover(substrings.COVER, substrings.PERIOD)
    assert not substrings.is_cover((0, 1, 2), 21)


@pytest.mark.parametrize("most", [None, 1])
def test_suffixes(docs, rows, nothing, most, monkeypatch):
    """With ``most`` = 1 every class of several fragments is decided by its windows' hashes."""
    if most:
        monkeypatch.setattr(suffixes, "CLASS_BYTES", most * 160)
        monkeypatch.setattr(B, "BLOCK_BYTES", 5000)
    width = 80
    texts = [(t or "").encode() for _, t, *_ in rows]
    times = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    expected = Counter()
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        gone = _covered(len(t), [i for i in range(len(t) - width + 1) if times[t[i : i + width]] > 1], width)
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        expected[(doc_id, len(t), sum(gone), spans, _sha(bytes(x for x, g in zip(t, gone, strict=True) if not g)))] += 1
    found = suffixes.dedup_byte_strings(docs, width, 16)
    assert _as_set(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert suffixes.dedup_byte_strings(nothing).count() == 0


def test_suffix_array_and_shared_starts():
    rng = random.Random(3)
    for n in (1, 2, 50, 2000):
        symbols = np.array([rng.randrange(3) for _ in range(n)])
        listed = symbols.tolist()
        assert suffixes.suffix_array(symbols).tolist() == sorted(range(n), key=lambda i: listed[i:])  # noqa: B023
    base = bytes(rng.choice(b"ab c\0") for _ in range(500))
    texts = list(dict.fromkeys(base[rng.randrange(90) :][: rng.randrange(400)] for _ in range(30)))
    for width in (1, 7, 9, 21, 22, 200):
        times = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
        expected = [[i for i in range(len(t) - width + 1) if times[t[i : i + width]] > 1] for t in texts]
        assert [x.tolist() for x in suffixes.shared_starts(texts, width)] == expected


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))


@pytest.mark.parametrize("ranks", [tokens.RANKS, None])
def test_token_ids_of_chunks(ranks):
    own = tokens.Encoder(tokens.vocabulary_path(tokens.VOCABULARY), ranks and tokens.vocabulary_path(ranks), huge=200, chunk=150, overlap=6)
    whole = _tokenizer()
    texts = ["", "  a  b ", "a<|endoftext|>b  \n c\n d" * 60, "x" * 900, "é" * 300 + " " + "ü\x1c a" * 99, "\n" * 400, " " * 500 + "a", "日本語 テキスト " * 50]
    for text in [*texts, *(t for _, t, *_ in _corpus() if t)]:
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, nothing):
    whole = _tokenizer()
    expected = Counter()
    for doc_id, text, *_ in rows:
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        expected[(doc_id, len((text or "").encode()), n, n > 1024)] += 1
    assert _as_set(tokens.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert tokens.count_tokens(nothing).count() == 0


def test_packing(docs, rows, nothing):
    whole = _tokenizer()
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            expected[(doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    found = packing.pack_documents(docs).toPandas()
    by_key = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert by_key == expected
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 2048
    assert packing.pack_documents(nothing).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 129, 6000)
    sequences = packing.pack(lengths, 128)
    assert sorted(i for s in sequences for i in s) == list(range(6000))
    assert max(lengths[s].sum() for s in sequences) <= 128
    assert len(sequences) <= 1.02 * lengths.sum() / 128 + 2
    assert packing.pack(np.zeros(0, np.int64)) == []


def _fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(values: list[int], distance: int) -> list[int]:
    group = list(range(len(values)))
    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= distance and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_simhash(docs, rows, nothing):
    values = [_fingerprint(t) for _, t, *_ in rows]
    group = _groups(values, 2)
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    expected = Counter((r[0], f"{v:016x}", least[g]) for r, v, g in zip(rows, values, group, strict=True))
    assert _as_set(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.drop_near_duplicates(docs).count() == len(set(group))
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_of_many_close_fingerprints(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(300)}
    # Two pieces of one block in which all values agree elsewhere, so many that flips are probed.
    near |= {centre ^ x for x in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    values = sorted(near)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from stepledger.llm.components import components

    found = {r.a: r.b for r in components(simhash.links(spark.createDataFrame(signed, "bits bigint"))).collect()}
    group = _groups(values, 2)
    root = [found.get(s[0], s[0]) for s in signed]
    assert len(set(zip(group, root, strict=True))) == len(set(group)) == len(set(root))


def _plain_distance(pattern: str, text: str) -> int:
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontamination.least_distance(pattern, text) == _plain_distance(pattern, text)


def test_decontamination(spark, nothing, monkeypatch):
    rng = random.Random(8)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (5, 20, 90, 200, 300)]
    table = [*enumerate(items), (7, None), (8, ""), (9, "!?"), (None, "an item without an id, long enough"), (2, items[2])]

    def edited(text: str, edits: int) -> str:
        chars = list(text)
        for _ in range(edits):
            k = rng.randrange(max(1, len(chars) - 1))
            chars[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [*chars[k : k + 1], "q"]])
        return "".join(chars)

    texts = [None, "", "nothing of it", table[8][1].upper()]
    for item in items:
        texts += ["before " + edited(item, n) + " after, " + "filler " * 30 for n in (0, 1, 4, 9, 14, 25, 60)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], SCHEMA).withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(table, "item_id bigint, text string")
    expected = Counter()
    for k, text in enumerate(texts):
        for item, wanted in dict.fromkeys(table):
            plain = decontamination.normal(wanted)
            # Up to the budget; nearer hits may come in at a stretch of text that no piece points at, never farther ones.
            if plain and text and (d := _plain_distance(plain, decontamination.normal(text))) <= decontamination.budget(len(plain)):
                expected[(k, item, d)] += 1
    assert len(expected) > 12
    found = decontamination.contaminations(docs, bench)
    assert _as_set(found, "doc_id", "item_id", "distance") == expected
    monkeypatch.setattr(decontamination, "ITEM_BLOCK_CHARS", 100)
    blocks = list(decontamination.item_blocks(bench, 100))
    assert len(blocks) > 2 and sorted(x[1] for b in blocks for x in b) == sorted({decontamination.normal(t) for _, t in table} - {""})
    kept = decontamination.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, *_ in expected}
    assert decontamination.contaminations(nothing, bench).count() == 0
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


def test_rules(docs, rows, nothing):
    expected = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        w, seen, repeated_lines = WORD.findall(text), set(), 0
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = _covered(len(w), [i for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1], 3)
        for line in text.split("\n"):
            if WORD.search(line):
                repeated_lines += line in seen
                seen.add(line)
        n_symbols = sum(c in rules.SYMBOLS for c in text)
        failed = len(w) < 50 or 100 * sum(twice) > 50 * len(w)
        expected[(doc_id, len(w), sum(map(len, w)), n_symbols, repeated_lines, sum(twice), failed)] += 1
    found = rules.quality_rules(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert _as_set(found, *columns) == expected
    assert found.where("kept AND base_failed").count() == 0
    assert rules.quality_rules(nothing).count() == 0


def _distance(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = np.array(a) / sum(a), np.array(b) / sum(b)
    m = (p + q) / 2
    terms = [x * np.log2(x / y) for one in (p, q) for x, y in zip(one, m, strict=True) if x > 0]
    return np.sqrt(max(sum(terms), 0) / 2)


def test_rules_against_plain_histograms(spark):
    """Histograms, references, distances and verdict by loops; some rows are in another language than they say, or in none."""
    rng = random.Random(8)
    own_words = {lang: rules.COMMON_WORDS[k * 10 : k * 10 + 10] + ["".join(rng.choices(letters, k=4)) for _ in range(40)] for k, (lang, letters) in enumerate([("x1", "abcé"), ("x2", "defß")])}
    weights, rows = [1 / (k + 1) for k in range(50)], []
    for k in range(90):
        lang = ("x1", "x2", "")[k % 3]
        of = {"x1": "x1", "x2": "x2", "": "x1"}[lang] if k % 10 else "x2"
        words = rng.choices(own_words[of], weights, k=rng.choice([20, 60, 150, 400]))
        text = " ".join(w.title() if rng.random() < 0.2 else w for w in words) + rng.choice(["", ".", " 12, 13!", "\n# $"])
        rows.append((k, text, lang or rng.choice([None, ""])))
    rows += [(90, None, "x1"), (91, "", "lone"), (92, "1 2 3 " * 40, "x2"), (93, rows[-1][1] + " " + rows[-4][1], "lone"), (0, rows[0][1], "x1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    plain = []
    for doc_id, text, lang in rows:
        text, times = text or "", Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        chars = [sum(map(test, text)) for test in (str.isupper, str.islower, str.isdigit, lambda c: c in " \t\n", lambda c: c in rules.PUNCTUATION)]
        words = [times[w] for w in rules.COMMON_WORDS]
        plain.append((doc_id, lang or "", text, chars + [len(text) - sum(chars)], words + [sum(times.values()) - sum(words)]))
    got = rules.quality_rules(docs).collect()
    failed = {(r.doc_id, r.n_words): r.base_failed for r in got}
    good = [p for p in plain if not failed[p[0], len(p[2].split())] and 10 * sum(c in rules.SYMBOLS for c in p[2]) <= len(p[2].split())]
    expected = Counter()
    for doc_id, lang, text, chars, words in plain:
        mine = [p for p in good if lang and p[1] == lang] or good
        n = len(text.split())
        by_char = _distance(chars, np.sum([p[3] for p in mine], axis=0)) if len(text) >= rules.MIN_CHARS else None
        by_word = _distance(words, np.sum([p[4] for p in mine], axis=0)) if n >= rules.MIN_JUDGED_WORDS else None
        kept = not failed[doc_id, n] and (by_char or 0) <= rules.MAX_CHAR_DISTANCE and (by_word or 0) <= rules.MAX_WORD_DISTANCE
        expected[(doc_id, n, *(None if x is None else round(float(x), 9) for x in (by_char, by_word)), kept)] += 1
    rounded = [tuple(None if x is None else round(x, 9) for x in (r.char_distance, r.word_distance)) for r in got]
    assert Counter((r.doc_id, r.n_words, *pair, r.kept) for r, pair in zip(got, rounded, strict=True)) == expected
    judged = [(d, kept) for *_, d, kept in expected if d is not None]
    assert any(kept for _, kept in judged) and any(d > rules.MAX_WORD_DISTANCE and not kept for d, kept in judged)


def test_jensen_shannon(spark):
    pairs = [([1, 1], [1, 1], 0.0), ([1, 0], [0, 5], 1.0), ([3, 1], [1, 3], None), ([0, 0], [1, 1], None)]
    df = spark.createDataFrame([([*map(float, a)], [*map(float, b)]) for a, b, _ in pairs], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(rules.jensen_shannon(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [0.0, 1.0] and got[3] is None
    p, q = np.array([0.75, 0.25]), np.array([0.25, 0.75])
    m = (p + q) / 2
    assert abs(got[2] - np.sqrt((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)) < 1e-12


def test_language(docs, rows, nothing):
    found = langid.learn_and_identify(docs)
    got = {(r.doc_id, r.text): r for r in found.select("doc_id", F.col("row.text").alias("text"), "lang_pred", "score", "held_out", "rejected").collect()}
    for doc_id, text, *_ in rows:
        r = got[(doc_id, text)]
        assert 0 <= r.score <= 1 and r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and (r.lang_pred != "und" or r.rejected)
    assert found.count() == len(rows)
    assert langid.learn_and_identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.learn_and_identify(table).where("held_out").select("lang_pred", F.col("row.lang").alias("lang"), "rejected").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95 and found.rejected.mean() < 0.02


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(r[0], k % 2, None) for k, r in enumerate(rows)] + [(5, None, 1), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.learn_and_score(docs, labels)
    scored = found.select("doc_id", "score", "predicted", "held_out").collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert quality.learn_and_score(nothing, labels).count() == 0
    assert {r.score for r in quality.learn_and_score(docs, labels.limit(0)).select("score").collect()} == {0.5}


def test_quality_features():
    text = "ab  ab\tcde\n".encode()
    found, owner, n = quality.features(text)
    assert n == 3 and Counter(owner.tolist()) == Counter({0: 1 + 3 + 2 + 1, 1: 1 + 1 + 3 + 2 + 1, 2: 1 + 4 + 3 + 2})
    long = ("word " * 200_000 + "x" * 700_000).encode()
    assert b"".join(quality.parts(long)) == long
    model = quality.train([b"good text here"] * 9 + [b"bad### stuff###"] * 9, [1] * 9 + [0] * 9)
    assert model.score(b"good text") > 0.5 > model.score(b"stuff### bad###")


def test_quality_learns_from_whole_texts(spark):
    """What tells the classes apart stands at one place of long texts only; a text beyond one part has the shares of its words."""
    rng = random.Random(3)
    filler = [f"w{k}" for k in range(200)]

    def text(label):
        words = rng.choices(filler, k=3000)
        at = rng.randrange(3000)
        return " ".join(words[:at] + (["splendid"] if label else ["dreadful"]) * 300 + words[at:])

    made = [(k, text(k % 2)) for k in range(120)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in made], "doc_id bigint, quality int")
    bags, targets = quality.sample(docs, labels)
    assert len(bags) > 100 and sum(targets) in range(50, 61)
    expected = {k % 2: [] for k in range(2)}
    for k, x in made:
        expected[k % 2].append(quality.bag(x.encode())[1].tobytes())
    assert all(shares.tobytes() in expected[label] for (_, shares), label in zip(bags, targets, strict=True))
    model = quality.train_bags(bags, targets, epochs=60)  # 120 rows give few steps
    by_label = [[model.score(text(label).encode()) for _ in range(20)] for label in range(2)]
    assert max(by_label[0]) < min(by_label[1])
    long = " ".join(rng.choices(filler, k=120_000)).encode()
    assert len(long) > 2 * quality._PART
    found, owner, n = quality.features(long)
    own, shares = quality.bag(long)
    plain = np.bincount(found, 1 / np.bincount(owner, minlength=n)[owner], quality.BUCKETS) / n
    # Words that repeat the word before them are told at the edges of parts only by their own part.
    assert np.abs(plain[1:] - np.bincount(own, shares, quality.BUCKETS)[1:]).max() < 1e-5


def test_quality_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.learn_and_score(documents, labels).where("held_out").select("doc_id", "predicted").join(labels, "doc_id").toPandas()
    assert (found.predicted == found.quality).mean() > 0.97
