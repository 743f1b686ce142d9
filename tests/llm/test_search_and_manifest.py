"""Ranked search, Merkle manifest and nearest neighbours against plain versions of their definitions, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepledger.llm import merkle, neighbours, ranking

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHING = ["tree", "position", "digest", "claim", "total", "block", "item", "rank", "score", "n", "terms", "cell", "shelf", "h1", "v", "id"]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {k: k + 32 for k in range(65, 91)}


def _clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def _lower(text: str) -> str:
    return text.translate(_LOWER)


def _documents() -> list[tuple]:
    rng = random.Random(8)
    words = ["the", "The", "a", "of", "straße", "Été", "ÉTÉ", "x1", "2024", "don't", "na-ïve", "日本", "q"]

    def text(n: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x00", "_", "  "]) for _ in range(n))

    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, " .,-\n", "en", "s", 5), (None, text(30), "en", "s", 1), (None, None, None, "s", 1)]
    rows += [(k, text(rng.randint(1, 60)), rng.choice(["en", "de", "ß", None]), rng.choice(["s", "Ä", None]), k) for k in range(4, 160)]
    rows += [(k, "the same words of a copied text", "en", "s", 31) for k in range(200, 290)]
    rows += [(400, text(90_000), "de", "s", 1), (401, "x" * 50_000, "de", "s", 1)]
    return [*rows, rows[30], rows[30], (rows[40][0], "the other text", "fr", "s", 1)]


@pytest.fixture(scope="module")
def rows():
    return _documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return _clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- ranked search ----

ITEMS = [
    (1, "The straße of 2024, don't"),
    (2, "a copied text of the words"),
    (3, None),
    (4, ""),
    (5, "no such thing anywhere"),
    (None, "日本 the q"),
    (6, "the the THE été"),
    (6, "the the THE été"),
    (6, "x1"),
]


def _ranked(rows, items, k: int) -> Counter:
    held = [(d, Counter(TERM.findall(_lower(text or "")))) for d, text, *_ in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, c, n in held:
            m = 50 + 50 * n * len(held) // total
            own = {t for t in TERM.findall(_lower(text or "")) if t in c}
            weights = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in own}
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items())
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out.update((item, place, doc, -score) for place, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("bounds", [None, 1])
@pytest.mark.parametrize("k", [50, 3])
def test_ranked_search(spark, docs, rows, k, bounds, monkeypatch):
    """With ``bounds`` = 1 an item is a block, and trees are small."""
    if bounds:
        monkeypatch.setattr(ranking, "ITEM_BYTES", 12)
        monkeypatch.setattr(ranking, "TREE_ROWS", 7)
        monkeypatch.setattr(ranking, "SEED_SHARE", 2)
    items = _clashing(spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    found = ranking.rank_documents(docs, items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == _ranked(rows, ITEMS, k)


def test_ranked_search_of_nothing(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert ranking.rank_documents(nothing, items).count() == 0
    assert ranking.rank_documents(docs, items.where("false")).count() == 0
    assert ranking.rank_documents(docs.where("text IS NULL"), items).count() == 0


def test_terms_of_a_long_text(monkeypatch):
    text = "Été one_two three " * 50
    monkeypatch.setattr(ranking, "_SLICE", 5)
    assert [t.decode() for part in ranking.terms(text.encode()) for t in part] == TERM.findall(_lower(text))


def test_node_pairs_are_pruned_and_results_stay_exact():
    """Two kinds of documents and items that share no term: no pair of single rows of unlike kinds is scored."""
    rng = np.random.default_rng(3)
    rows, items = [], []
    for n in range(400):
        ids = np.sort(rng.choice(40, 12, replace=False)) + 40 * (n % 2)
        rows.append((ids, rng.integers(1, 1000, 12)))
    for n in range(20):
        items.append((np.sort(rng.choice(40, 6, replace=False)) + 40 * (n % 2)).tolist())
    search = ranking.Search(ranking.Items(items, 80), 5)
    ptr = np.arange(0, 12 * 401, 12)
    search.add(ranking.Rows(ptr, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])), list(range(400)))
    found = sorted(search.found())
    expected = []
    for n, own in enumerate(items):
        scores = [(-int(values[np.isin(ids, own)].sum()), d) for d, (ids, values) in enumerate(rows)]
        expected += [(n, d, -s) for s, d in sorted(scores)[:5] if s < 0]
    assert found == sorted(expected)
    assert search.pairs < 400 * 20


# ---- manifest ----


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values) -> str:
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    paths: list[list] = [[] for _ in nodes]
    level, at = nodes, list(range(len(nodes)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append((p % 8, run[: p % 8] + run[p % 8 + 1 :]))
        level, at = [_h(*level[a : a + 8]) for a in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def _manifest(rows) -> Counter:
    trees: dict = {}
    for doc, text, lang, source, n in rows:
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        found = _lower(text) if hit and text is not None else text
        trees.setdefault(lang, []).append((doc is not None, doc or 0, _leaf(doc, source, lang, n, text), _leaf(doc, source, lang, n, found), doc))
    keys = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for key in keys:
        trees[key].sort()
        below[key] = _tree([leaf for _, _, leaf, *_ in trees[key]])
    root, tops = _tree([below[key][0] for key in keys])
    out = Counter()
    for key, top in zip(keys, tops, strict=True):
        for (_, _, leaf, folded, doc), own in zip(trees[key], below[key][1], strict=True):
            for place, siblings in own + top:
                folded = _h(*siblings[:place], folded, *siblings[place:])
            proof = _h(*[s for _, siblings in own + top for s in siblings])
            out[(doc, leaf, below[key][0], root, proof, folded, folded == root)] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest(docs, rows, levels, monkeypatch):
    """With one level to a block, the tree has several storeys."""
    monkeypatch.setattr(merkle, "manifest", lambda leaves, build=merkle.manifest: build(leaves, levels))
    found = merkle.document_manifest(docs, merkle.lower_cased(docs))
    assert Counter(map(tuple, found.select(COLUMNS).collect())) == _manifest(rows)
    assert merkle.document_manifest(docs).where("NOT verified").count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_one_language(spark, n):
    rows = [(k, f"Text {k}", "en", None, k) for k in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, merkle.document_manifest(docs, merkle.lower_cased(docs)).select(COLUMNS).collect())) == _manifest(rows)


def test_manifest_of_nothing_and_of_many_languages(spark, nothing):
    assert merkle.document_manifest(nothing).count() == 0
    rows = [(k, "t", f"l{k % 77}", None, None) for k in range(150)]
    found = merkle.document_manifest(spark.createDataFrame(rows, SCHEMA))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root) for r in found.collect()) == Counter(
        (doc, _leaf(doc, None, lang, None, text), *key[2:4]) for doc, text, lang, *_ in rows for key in _manifest(rows) if key[0] == doc
    )


def test_witnesses_grow_with_the_tree():
    """What is known early is a prefix of the whole witness, and every sibling comes from a completed run."""
    tree, digests = merkle.Appender(), [hashlib.sha256(bytes([k])).digest() for k in range(70)]
    early = {}
    for k, digest in enumerate(digests):
        tree.append(digest)
        early[k] = tree.witnesses()
    root = tree.close(merkle.height(70))
    whole = tree.witnesses()
    leaves = [n for n, d in enumerate(tree.digests) if d in set(digests)]
    for known in early.values():
        assert all(whole[n].startswith(w) for n, w in enumerate(known))
    assert all(merkle.fold(tree.digests[n], whole[n]) == root for n in leaves)
    assert len(early[7][0]) == 2 + 7 * 32 and len(early[6][0]) == 0


# ---- nearest neighbours ----

VECTORS = "vec_id bigint, embedding array<double>, label int"


def _cosine_rows(spark, n: int, dim: int = 16):
    rng = np.random.default_rng(4)
    return [(k, rng.normal(size=dim).tolist(), 0) for k in range(n)]


def _exact(rows, every: int = 50, k: int = 5) -> dict:
    fine = [(d, np.array(v, float)) for d, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = Counter(len(v) for _, v in fine).most_common(1)[0][0]
    fine = [x for x in fine if len(x[1]) == dim]
    out = {}
    for at, (d, v) in enumerate(fine):
        if d is not None and d % every == 0:
            scores = [(-(u @ v) / math.sqrt((u @ u) * (v @ v)), c is None, c or 0, c) for n, (c, u) in enumerate(fine) if n != at]
            out.setdefault(d, []).append([(c, -s) for s, _, _, c in sorted(scores, key=lambda x: (round(x[0], 12), *x[1:3]))[:k]])
    return out


def _results(found) -> dict:
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_all_neighbours_when_all_cells_are_visited(spark):
    rows = _cosine_rows(spark, 400)
    hot = rows[7][1]
    rows += [(k, hot, 0) for k in range(1000, 1100)] + [(None, hot, 0)] + [(k, [2 * x for x in rows[9][1]], 0) for k in (2000, 2001)]
    rows += [(3000, None, 0), (3050, [0.0] * 16, 0), (3100, [1.0] * 15 + [None], 0), (3150, [math.nan] * 16, 0), (3200, [math.inf] + [1.0] * 15, 0)]
    rows += [(3250, [], 0), (3300, [1.0, 2.0], 0), (3350, [1e300] * 16, 0), (3351, [1e-300] * 16, 0)]
    expected = _exact(rows[:-2] + [(3350, [1.0] * 16, 0), (3351, [1.0] * 16, 0)])
    vectors = _clashing(spark.createDataFrame(rows, VECTORS).repartition(3))
    found = _results(neighbours.nearest(vectors, recall=1.0))
    assert set(found) == set(expected) and 3350 in found and not {3000, 3050, 3100, 3150, 3200, 3250, 3300} & set(found)
    missed = 0
    for query, (own,) in expected.items():
        assert [rank for rank, *_ in found[query]] == [1, 2, 3, 4, 5]
        missed += len({c for c, _ in own} - {c for _, c, _ in found[query]})
        assert all(abs(dict(own)[c] - s) < 1e-12 for _, c, s in found[query] if c in dict(own))
    assert missed == 0
    assert [c for _, c, _ in found[1000]] == [7, 1001, 1002, 1003, 1004] and [c for _, c, _ in found[1050]] == [7, 1000, 1001, 1002, 1003]


def test_neighbours_of_repeated_rows_and_few_rows(spark, nothing):
    v = [1.0, 0.0, 2.0]
    rows = [(50, v, 0), (50, v, 0), (1, [0.0, 1.0, 0.0], 0)]
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == {(50, 1, 50, 1.0): 2, (50, 2, 1, 0.0): 2}
    assert neighbours.nearest(spark.createDataFrame(rows[:1], VECTORS)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_and_crowded_shelves(spark, monkeypatch):
    """Two fifths of the vectors lie close together; shelves and shares are small, so that both are split."""
    monkeypatch.setattr(neighbours, "SHELF_ROWS", 150)
    monkeypatch.setattr(neighbours, "SHARE_QUERIES", 10)
    rng = np.random.default_rng(9)
    rows = _cosine_rows(spark, 1500)
    rows += [(k, (np.array(rows[0][1]) + rng.normal(size=16) / 1000).tolist(), 0) for k in range(2000, 3000)]
    expected, found = _exact(rows, 10), _results(neighbours.nearest(spark.createDataFrame(rows, VECTORS), every=10, centroids=16))
    hits = sum(len({c for c, _ in own} & {c for _, c, _ in found[q]}) for q, (own,) in expected.items())
    assert set(found) == set(expected) and hits >= 0.9 * 5 * len(expected)
    assert all(len(x) == 5 and [s for *_, s in x] == sorted([s for *_, s in x], reverse=True) for x in found.values())


def test_visits_go_by_the_sum_of_distances():
    rng = np.random.default_rng(1)
    index = neighbours.Index(rng.normal(size=(400, 8)), 12)
    first, second = rng.random(12), rng.random(12)
    sums = first[:, None] + second[None, :]
    visited = list(index.visit(first, second))
    assert sorted(visited) == list(range(144))
    assert np.allclose(sums.ravel()[visited], np.sort(sums.ravel()))


def test_shelves_hold_every_cell():
    counts = np.array([0, 3, 90, 10, 0, 31, 1, 1, 200, 0])
    shelves = neighbours.Shelves(counts, 30)
    for cell in range(len(counts)):
        for shelf in range(shelves.first[cell], shelves.first[cell] + shelves.pieces[cell]):
            assert shelves.spans[shelf][0] <= cell < shelves.spans[shelf][1]
    assert max(sum(counts[a:b]) for a, b in shelves.spans if b - a > 1) <= 30
    assert shelves.visited(np.array([2])).tolist() == [shelves.first[2], shelves.first[2] + 1, shelves.first[2] + 2]
