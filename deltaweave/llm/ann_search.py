"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample by repeated halving at the median of a
two-means direction, so every list gets an equal share of the sample, and a few
rounds of k-means in which full lists are farther away.  They
stay in memory with a graph of near neighbours, which a beam search walks for
every vector and query.  A vector joins its nearest list and, if it lies on a
boundary, further ones within a distance ratio.  A query reads the lists within
a wider distance ratio of its nearest one, and always enough of them to hold
``LEAST_FOUND`` vectors; where vectors have little structure, ratios are close
to one and it reads up to one list in ``BEAM_SHARE``.

The postings of all vectors are a table.  Lists and the queries on them are cut
into blocks of bounded size, each pair of blocks is compared by one task in
double precision, and the best of each block are merged.  A list that grows
hot by copies is just more blocks.

Only the sample (``SAMPLE`` vectors), its centroids and graph are collected and
broadcast; their size does not grow with the table.

The lists grow with the vectors up to ``MOST_LISTS``; beyond some half a million
vectors they grow longer instead, and a query reads more vectors in proportion.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do those without an id; vectors of each length are
searched apart, as there is no distance between two lengths; every row but the
query's own is a candidate, so repeated ids and rows have places of their own,
and a repeated query has its ranks for each row; equal distances are ordered by
id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep, leaving_nothing

SAMPLE, MOST_LISTS, LIST_SIZE = 32_768, 4096, 128
NEIGHBOURS, BEAM, BEAM_SHARE, STEPS = 16, 96, 4, 6
COPY_RATIO, MOST_COPIES, READ_RATIO, LEAST_FOUND = 1.15, 4, 1.4, 256
BLOCK = 4096
#: Rounds that move centroids to their members; distance added for a full list.
ROUNDS, CROWDING = 6, 0.05
_STRIP = 1024


def _halve(points: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a cluster in two equal parts."""
    x = points[rows]
    a, b = x[random.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
        order = np.argsort(side, kind="stable")
        half = len(x) // 2
        a, b = x[order[:half]].mean(0), x[order[half:]].mean(0)
    return rows[order[:half]], rows[order[half:]]


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Means of the leaves of a halving tree of at least ``lists`` leaves."""
    random = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    leaves = [np.arange(len(points))]
    while len(leaves) < lists and max(map(len, leaves)) > 1:
        leaves = [part for leaf in leaves for part in (_halve(points, leaf, random) if len(leaf) > 1 else (leaf,))]
    centroids = np.array([points[leaf].mean(0) for leaf in leaves])
    size, mean = np.full(len(centroids), len(points) / len(centroids)), len(points) / len(centroids)
    for _ in range(ROUNDS if len(centroids) > 1 else 0):
        apart = (points * points).sum(1).mean() + (centroids * centroids).sum(1).mean() - 2 * points.mean(0) @ centroids.mean(0)
        crowded = CROWDING * apart * np.maximum(size / mean - 1, 0)
        # a strip of points at a time: all distances together would fill the driver
        side = np.concatenate([np.argmin(_squares(points[i : i + _STRIP], centroids) + crowded, axis=1) for i in range(0, len(points), _STRIP)])
        size = np.bincount(side, minlength=len(centroids)).astype(float)
        for c in np.flatnonzero(size):
            centroids[c] = points[side == c].mean(0)
    return np.unique(centroids, axis=0)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


class CentroidGraph:
    """Centroids with their near neighbours, searched by a beam."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        n = len(centroids)
        near = [np.argsort(_squares(centroids[i : i + 512], centroids), axis=1, kind="stable")[:, : NEIGHBOURS + 1] for i in range(0, n, 512)]
        self.near = np.concatenate(near).astype(np.int32) if near else np.zeros((0, 1), np.int32)
        self.widest = max(BEAM, n // BEAM_SHARE)
        self.entries = np.random.default_rng(5).permutation(n)[: max(self.widest, 2 * int(np.sqrt(n)))].astype(np.int32)

    def search(self, x: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(list, distance) of up to ``most`` near centroids of each row, nearest first."""
        most = min(most or self.widest, len(self.centroids))
        at = np.argsort(_squares(x, self.centroids[self.entries]), axis=1, kind="stable")[:, :most]
        beam = self.entries[at]
        for _ in range(STEPS):
            wider = np.sort(np.concatenate([beam, self.near[beam[:, : max(1, most // 3)]].reshape(len(x), -1)], axis=1), axis=1)
            again = np.zeros(wider.shape, bool)
            again[:, 1:] = wider[:, 1:] == wider[:, :-1]
            d = self._distances(x, wider)
            d[again] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            nearer = np.take_along_axis(wider, order, 1)
            if nearer.shape == beam.shape and (nearer == beam).all():
                break
            beam = nearer
        d = np.sqrt(self._distances(x, beam))
        double = np.zeros(beam.shape, bool)
        sort = np.sort(beam, axis=1)
        if (sort[:, 1:] == sort[:, :-1]).any():  # fewer centroids met than asked for
            for i, row in enumerate(beam):
                first = np.unique(row, return_index=True)[1]
                double[i] = True
                double[i, first] = False
            d[double] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            beam, d = np.take_along_axis(beam, order, 1), np.take_along_axis(d, order, 1)
        return beam, d

    def _distances(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        c = self.centroids[lists]
        return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(2) - 2 * np.einsum("id,ijd->ij", x, c), 0)

    def copies(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each vector joins."""
        lists, d = self.search(x, 4 * MOST_COPIES)
        row, place = np.nonzero(np.isfinite(d[:, :MOST_COPIES]) & (d[:, :MOST_COPIES] <= COPY_RATIO * d[:, :1]))
        return row, lists[row, place]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, rows numbered in scratch."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(~wrong & some)
    return keep(rows.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")), "vectors")


def _posting(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, lists = map(pa.array, shared.value.copies(_matrix(part.column(2))))
                yield pa.RecordBatch.from_arrays([lists.cast(pa.int32()), *(part.column(c).take(rows) for c in range(3))], ["list", "row", "vec_id", "v"])

    return run


def _probing(shared, sizes: np.ndarray) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists, d = shared.value.search(_matrix(part.column(2)))
                before = np.cumsum(sizes[lists], axis=1) - sizes[lists]
                read = np.isfinite(d) & ((d <= READ_RATIO * d[:, :1]) | (before < LEAST_FOUND))
                rows, place = np.nonzero(read)
                yield pa.RecordBatch.from_arrays([pa.array(lists[rows, place], pa.int32()), *(part.column(c).take(pa.array(rows)) for c in range(3))], ["list", "query_row", "query_id", "q"])

    return run


def _best_of_blocks(k: int) -> Callable:
    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        if postings.num_rows and queries.num_rows:
            rows, ids = (postings.column(c).to_numpy() for c in ("row", "vec_id"))
            v, q = _matrix(postings.column("v").combine_chunks()), _matrix(queries.column("q").combine_chunks())
            for row, query, x in zip(queries.column("query_row").to_pylist(), queries.column("query_id").to_pylist(), q, strict=True):
                d = np.sqrt(((v - x) ** 2).sum(1))
                d[rows == row] = np.inf
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > 4 * k else np.arange(len(d))
                best = near[np.lexsort((rows[near], ids[near], d[near]))][:k]
                best = best[np.isfinite(d[best])]
                out["query_row"] += [row] * len(best)
                out["query_id"] += [query] * len(best)
                out["row"] += rows[best].tolist()
                out["vec_id"] += ids[best].tolist()
                out["score"] += d[best].tolist()
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each query.

    Both tables are those of :func:`usable`; a query's row is no candidate of its own.
    """
    out, first = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), True
    for length in sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect()):
        same = F.size("v") == length
        found = _search(vectors.where(same), queries.where(same), k)
        out = found if first else out.unionByName(found)
        first = False
    return out


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:func:`nearest` of vectors of one length; there are some."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("v").toArrow()
    lists = min(MOST_LISTS, max(1, vectors.count() // LIST_SIZE), max(1, sample.num_rows // 8))
    shared = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(_matrix(sample.column("v").combine_chunks()), lists)))
    kind = vectors.schema["v"].dataType.simpleString()
    postings = keep(vectors.select("row", "vec_id", "v").mapInArrow(leaving_nothing(_posting(shared)), f"list int, row long, vec_id long, v {kind}"), "postings")
    n_lists = len(shared.value.centroids)

    def counts(table: DataFrame) -> np.ndarray:
        out = np.zeros(n_lists, np.int64)
        for row in table.groupBy("list").count().collect():
            out[row["list"]] = row["count"]
        return out

    sizes = counts(postings)
    probes = queries.select("row", "vec_id", "v").mapInArrow(leaving_nothing(_probing(shared, sizes)), f"list int, query_row long, query_id long, q {kind}")
    probes = keep(probes, "probes")
    table = spark.createDataFrame(
        [(i, max(1, -(-int(a) // BLOCK)), max(1, -(-int(b) // BLOCK))) for i, (a, b) in enumerate(zip(sizes, counts(probes), strict=True))],
        "list int, v_blocks int, q_blocks int",
    )
    known = F.broadcast(table)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = postings.join(known, "list").select("list", F.pmod(F.xxhash64("row"), "v_blocks").cast("int").alias("v_block"), each("q_blocks").alias("q_block"), "row", "vec_id", "v")
    right = probes.join(known, "list").select("list", F.pmod(F.xxhash64("query_row"), "q_blocks").cast("int").alias("q_block"), each("v_blocks").alias("v_block"), "query_row", "query_id", "q")
    keys = ("list", "v_block", "q_block")
    schema = "query_row long, query_id long, row long, vec_id long, score double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of_blocks(k), schema)
    found = found.dropDuplicates(["query_row", "row"])
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
