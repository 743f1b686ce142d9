"""Nearest neighbours by cosine over an inverted multi-index.

Vectors of length one are cut in two halves, and each half has its own codebook. A pair of centroids is a cell, so two
codebooks of 128 make 16,384 cells. A query visits the cells by the sum of its two halves' distances, with a heap over
the pairs, until the cells visited hold as many entries as are wanted; these are reranked by their exact cosine. How many
are wanted is measured, not guessed: for a bounded number of queries the true neighbours are found by a scan of all
entries, and the count is the one at which the wished share of them has been reached.

The codebooks are learned from a bounded sample; every vector is indexed. Of equal vectors only the ``k + 1`` with the
smallest ids are entries, since no other can be among anyone's ``k`` nearest. Cells are laid on *shelves* of about
``SHELF_ROWS`` entries, a crowded cell on several, and a query goes once to each shelf that it visits, with the set of its cells;
shelves that many queries visit are served in several shares. So neither a crowded cell nor a popular one is a single task's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stepledger.llm.blocks import bounded_batches, field
from stepledger.storage import materialize

#: Centroids of a half; rows that the codebooks learn from; rounds of learning.
CENTROIDS, SAMPLE, ROUNDS = 128, 16_384, 12
#: Queries that the depth of the search is measured on, and the share of their true neighbours to reach.
TRIALS, RECALL = 256, 0.95
#: Entries of a shelf, and queries that one share of it serves.
SHELF_ROWS, SHARE_QUERIES = 2048, 8192
_SPAN = 1 << 40
_AT_ONCE = 128
#: Scores closer than this may swap their order when they are summed in another order.
_ROUNDING = 1e-9


# ---- one machine ----


def matrix(values: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that no square can overflow or vanish; exact, and the same direction."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal scores wherever they stand."""
    query, rows = scaled(query[None, :])[0], scaled(rows)
    return (rows * query).sum(axis=1) / np.sqrt((rows * rows).sum(axis=1) * (query * query).sum())


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1), 0)


def learn(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's centroids; those that lose all their points stay where they are."""
    start = np.random.default_rng(13).permutation(len(points))[:count]
    centres = points[start].copy()
    for _ in range(rounds):
        near = squared(points, centres).argmin(axis=1)
        sizes = np.bincount(near, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


class Index:
    """The two codebooks, and the number of entries in each cell."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS) -> None:
        points = np.unique(unit(sample), axis=0)
        self.half = points.shape[1] // 2
        self.size = min(centroids, max(1, len(points) // 8))
        self.books = [learn(points[:, : self.half], self.size), learn(points[:, self.half :], self.size)]
        self.counts = np.zeros(self.size**2, np.int64)

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = unit(rows)
        return squared(rows[:, : self.half], self.books[0]), squared(rows[:, self.half :], self.books[1])

    def cells(self, rows: np.ndarray) -> np.ndarray:
        first, second = self.distances(rows)
        return first.argmin(axis=1) * self.size + second.argmin(axis=1)

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Cells by the sum of a query's distances to their two centroids.

        A pair waits in the heap once both pairs that precede it, one step back in either half, have been visited.
        """
        rows, columns = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        near, far = np.sort(first).tolist(), np.sort(second).tolist()
        n = self.size
        done = [0] * n  # how many columns of each row have been visited
        heap = [(near[0] + far[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield rows[i] * n + columns[j]
            done[i] = j + 1
            if j + 1 < n and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (near[i] + far[j + 1], i, j + 1))
            if i + 1 < n and done[i + 1] == j:
                heapq.heappush(heap, (near[i + 1] + far[j], i + 1, j))

    def probe(self, first: np.ndarray, second: np.ndarray, wanted: int) -> list[int]:
        """The cells with entries, in order of their visit, up to the one with which ``wanted`` entries are reached."""
        out, seen, counts = [], 0, self.counts
        if wanted > 0:
            for cell in self.visit(first, second):
                if counts[cell]:
                    out.append(cell)
                    seen += int(counts[cell])
                    if seen >= wanted:
                        break
        return out


class Shelves:
    """Where the entries of each cell stand: small cells share a shelf, a large one has several of its own."""

    def __init__(self, counts: np.ndarray, rows: int) -> None:
        self.pieces = np.maximum(1, -(-counts // rows))
        self.first = np.zeros(len(counts), np.int64)
        #: Per shelf its cells, from one to before another.
        self.spans: list[tuple[int, int]] = []
        begin = held = 0
        for cell, n in enumerate([*counts.tolist(), rows + 1]):
            if held + n > rows and begin < cell:
                self.spans.append((begin, cell))
                begin, held = cell, 0
            if cell == len(counts):
                break
            self.first[cell] = len(self.spans)
            held += n
            if self.pieces[cell] > 1:
                self.spans += [(cell, cell + 1)] * int(self.pieces[cell])
                begin, held = cell + 1, 0

    def visited(self, cells: np.ndarray) -> np.ndarray:
        crowded = cells[self.pieces[cells] > 1]
        more = [np.arange(self.first[c], self.first[c] + self.pieces[c]) for c in crowded]
        return np.unique(np.concatenate([self.first[cells], *more]))


def best(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact cosines of the ``k`` nearest rows, ties to the smaller id; ``rough`` may be off by rounding."""
    at = np.flatnonzero(rough > -np.inf)
    if len(at) > k:
        least = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= least - _ROUNDING]
    exact = cosines(query, rows[at]) if len(at) else np.zeros(0)
    order = np.lexsort((ids[at], -exact))[:k]
    return at[order], exact[order]


# ---- all vectors ----


def usable(vectors: DataFrame, id_name: str, vector_name: str) -> tuple[DataFrame, int]:
    """``id, v, h1, h2`` and the length: vectors without null or non-finite components, with another than zero, of the most common length."""
    v = field(vector_name)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & fine).select(field(id_name).cast("bigint").alias("id"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    return rows.where(F.size("v") == dim).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), dim


def _sampled(rows: DataFrame, total: int, wanted: int, salt: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, the same ones whatever the partitioning."""
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "h1", "id"), F.lit(_SPAN)) < int(_SPAN * min(1.0, wanted / max(total, 1))))


def _in_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch))

    return df.mapInArrow(every, schema)


def _true_cells(entries: DataFrame, trials: np.ndarray, dim: int, k: int) -> list[tuple[int, int]]:
    """``(trial, cell)`` of the ``k`` nearest entries of each trial query, by a scan of all entries."""
    wanted = unit(trials)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.full((len(wanted), 0), 0.0), np.zeros((len(wanted), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                score = np.concatenate([score, wanted @ unit(matrix(batch["v"], dim)).T], axis=1)
                own = batch["cell"].to_numpy(zero_copy_only=False).astype(np.int64)
                cell = np.concatenate([cell, np.broadcast_to(own, (len(wanted), len(own)))], axis=1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.arange(score.shape[1])[None, :].repeat(len(wanted), 0)
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        trial = np.repeat(np.arange(len(wanted)), score.shape[1])
        yield pa.RecordBatch.from_pydict({"trial": trial, "score": score.ravel(), "cell": cell.ravel()})

    found = entries.select("v", "cell").mapInArrow(scan, "trial bigint, score double, cell bigint")
    order = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "cell"))
    return [(r.trial, r.cell) for r in found.withColumn("n", order).where(F.col("n") <= k).collect()]


def _reached(index: Index, trials: np.ndarray) -> np.ndarray:
    """Per trial and cell, the entries that have been visited when the cell has."""
    first, second = index.distances(trials)
    out = np.empty((len(trials), len(index.counts)), np.int64)
    for n in range(len(trials)):
        order = np.argsort((first[n][:, None] + second[n][None, :]).ravel(), kind="stable")
        out[n, order] = np.cumsum(index.counts[order])
    return out


def _collected(rows: DataFrame, dim: int) -> np.ndarray:
    return matrix(rows.select("v").toArrow()["v"], dim)


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    id_name: str = "vec_id",
    vector_name: str = "embedding",
    centroids: int = CENTROIDS,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows whose id ``every`` divides, the ``k`` nearest other rows found.

    ``score`` is the cosine in double precision; ties go to the smaller id, null ids last. Null, empty and zero vectors and
    those with null or non-finite components are neither queries nor candidates, nor are vectors of another length than
    the most common one. Only the query's own row is left out: an equal row, even with the same id, is a neighbour. Repeated
    query rows each get their result. Where there are fewer than ``k`` candidates, all are returned; no rows give no rows.
    The search is approximate: it visits as many entries as reach the share ``recall`` of TRIALS queries' true neighbours.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, dim = usable(vectors, id_name, vector_name)
    asked = rows.where(F.col("id") % every == 0)
    total, questions = rows.count(), asked.count()
    if not questions:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = Index(_collected(_sampled(rows, total, SAMPLE, 1), dim), centroids)

    # Entries with their cells, written once.
    copy = F.row_number().over(Window.partitionBy("h1", "v").orderBy(F.asc_nulls_last("id")))
    kept = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    schema = StructType([*kept.schema.fields, StructField("cell", IntegerType())])
    names = kept.columns

    def assign(batch: pa.RecordBatch) -> dict:
        return {c: batch[c] for c in names} | {"cell": index.cells(matrix(batch["v"], dim)).astype(np.int32)}

    entries = materialize(_in_arrow(kept, assign, schema), "entries")
    for r in entries.groupBy("cell").count().collect():  # at most centroids ** 2
        index.counts[r["cell"]] = r["count"]

    # How deep to search, and how many queries each shelf will see.
    trials = _collected(_sampled(asked, questions, TRIALS, 2), dim)
    reached = _reached(index, trials)
    needs = np.sort([reached[t, c] for t, c in _true_cells(entries, trials, dim, k + 1)])
    wanted = int(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))])
    shelves = Shelves(index.counts, SHELF_ROWS)
    hits = np.zeros(len(shelves.spans))
    for line in reached:
        hits[shelves.visited(np.flatnonzero((line - index.counts < wanted) & (index.counts > 0)))] += 1
    shares = np.maximum(1, np.ceil(hits / len(trials) * questions / SHARE_QUERIES)).astype(np.int64)

    def ask(batch: pa.RecordBatch) -> dict:
        first, second = index.distances(matrix(batch["v"], dim))
        source, shelf, probes = [], [], []
        for n in range(batch.num_rows):
            cells = np.array(index.probe(first[n], second[n], wanted), np.int64)
            flags = np.zeros(len(index.counts), bool)
            flags[cells] = True
            for s in shelves.visited(cells).tolist():
                a, b = shelves.spans[s]
                source.append(n)
                shelf.append(s)
                probes.append(np.packbits(flags[a:b]).tobytes())
        at, shelf = pa.array(source, pa.int64()), np.array(shelf, np.int64)
        out = {c: batch[c].take(at) for c in ("h1", "h2", "v")}
        share = out["h1"].to_numpy(zero_copy_only=False) % shares[shelf]
        return out | {"shelf": shelf, "share": share, "probes": pa.array(probes, pa.binary())}

    kind = rows.schema["v"].dataType.simpleString()
    questions_at = _in_arrow(
        asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v"), ask, f"h1 bigint, h2 bigint, v {kind}, shelf bigint, share bigint, probes binary"
    )
    layout = spark.createDataFrame(
        pd.DataFrame({"cell": np.arange(len(index.counts), dtype=np.int32), "first": shelves.first, "pieces": shelves.pieces, "shares": shares[shelves.first]})
    )
    laid = (
        entries.join(F.broadcast(layout), "cell")  # a row per cell
        .withColumn("shelf", F.col("first") + F.pmod("h2", "pieces"))
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
        .select("shelf", "share", "cell", "id", "v")
    )

    def search(table: pa.Table, questions: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if table.num_rows and questions.num_rows:
            points, asks = matrix(table["v"], dim), matrix(questions["v"], dim)
            ids, ends = table["id"], unit(points)
            numbers = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            begin, end = shelves.spans[table["shelf"][0].as_py()]
            inside = table["cell"].to_numpy() - begin
            flags = np.frombuffer(b"".join(questions["probes"].to_pylist()), np.uint8).reshape(len(asks), -1)
            h1, h2 = questions["h1"].to_numpy(), questions["h2"].to_numpy()
            for a in range(0, len(asks), _AT_ONCE):
                part = slice(a, a + _AT_ONCE)
                rough = unit(asks[part]) @ ends.T
                rough[~np.unpackbits(flags[part], axis=1, count=end - begin).astype(bool)[:, inside]] = -np.inf
                for n, line in enumerate(rough, a):
                    at, score = best(asks[n], points, numbers, line, k + 1)
                    for column, values in zip(out, (np.full(len(at), h1[n]), np.full(len(at), h2[n]), at, score, (points[at] == asks[n]).all(axis=1)), strict=True):
                        column.append(values)
        h1, h2, at, score, same = [np.concatenate(x) if x else np.zeros(0) for x in out]
        found = table["id"].take(pa.array(at.astype(np.int64))) if len(at) else pa.array([], pa.int64())
        columns = {"h1": pa.array(h1.astype(np.int64)), "h2": pa.array(h2.astype(np.int64)), "vec_id": found}
        return pa.table(columns | {"score": pa.array(score.astype(np.float64)), "same": pa.array(same.astype(bool))})

    groups = laid.groupBy("shelf", "share").cogroup(questions_at.groupBy("shelf", "share"))
    found = groups.applyInArrow(search, "h1 bigint, h2 bigint, vec_id bigint, score double, same boolean")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    lists = (
        found.withColumn("n", place)
        .where(F.col("n") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("found"))  # k + 1 at most
    )
    own = F.filter("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id")))
    rest = F.slice(F.filter("found", lambda x: ~x["n"].eqNullSafe(F.get(own, F.lit(0))["n"])), 1, k)
    return (
        asked.groupBy(F.col("id").alias("query_id"), "h1", "h2")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(lists, ["h1", "h2"])
        .select("query_id", rest.alias("rest"), F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
        .select("query_id", F.posexplode("rest").alias("place", "near"))
        .select("query_id", (F.col("place") + 1).alias("rank"), "near.vec_id", "near.score")
    )
