"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced bisection of a bounded sample; a graph that links each centroid to near ones finds the nearest
centroids of a vector in a few hops. Every vector goes to its nearest list, and a vector near a border also to the
other lists whose centroid is about as near. A query reads the lists whose centroid is within a ratio of its nearest
one's distance, however many they are. Lists that fill up beyond a bound are dealt in blocks, and
each block gives its best rows per query, so a task holds one block and the queries that read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.llm.common import Batches, rows_of, stored

SAMPLE = 20_000  # rows that the centroids are fitted on
LIST_ROWS = 400
MAX_LISTS = 4096  # centroids are broadcast: 4096 of them at most, whatever the table holds
DEGREE = 16
BLOCK_ROWS = 4000
STRIDE = 8  # steps of a walk per round


@dataclass(frozen=True)
class Search:
    """``replicas`` lists at most hold a vector, those within ``border`` times its nearest centroid's distance; a query
    reads the lists within ``reach`` times. ``beam`` candidates are kept open in a walk."""

    replicas: int = 2
    border: float = 1.01
    reach: float = 1.12
    beam: int = 24


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part.

    Left out: null ids, null or zero vectors, vectors with a null or non-finite component, and vectors of another length
    than most (ties: the shorter). Of rows that repeat an id the smallest vector counts.
    """
    vector = F.col(vector_column).cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("embedding")).where(F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    most = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (most["size"] if most else 0))


def bisected(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of ``lists`` equal parts: two means at a time, cut where the parts hold their share of the rows."""
    if lists <= 1 or len(points) <= 1:
        return points.mean(axis=0, keepdims=True)
    half = lists // 2
    spread = points - points.mean(axis=0)
    far = points[np.argmax((spread**2).sum(axis=1))]
    a, b = far, points[np.argmax(((points - far) ** 2).sum(axis=1))]
    at = max(1, min(len(points) - 1, round(len(points) * half / lists)))
    for _ in range(6):
        lean = points @ (b - a)
        order = np.argsort(lean, kind="stable")
        a, b = points[order[:at]].mean(axis=0), points[order[at:]].mean(axis=0)
    order = np.argsort(points @ (b - a), kind="stable")
    return np.concatenate([bisected(points[order[:at]], half), bisected(points[order[at:]], lists - half)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1), 0))


class CentroidGraph:
    """Centroids and links to near ones; neighbours in order of bisection are linked too, so all can be reached."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray | None = None, degree: int = DEGREE) -> None:
        """``links`` of a graph made before, which is then only taken up."""
        self.centroids = centroids
        k = len(centroids)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64))
        if links is not None:
            self.links = links
            return
        links = np.empty((k, min(degree, max(k - 1, 0)) + 2), np.int64)
        for at in range(0, k, 512):
            d = distances(centroids[at : at + 512], centroids)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, : links.shape[1] - 2]
            own = at + np.arange(len(d))
            links[at : at + 512] = np.column_stack([near, (own + 1) % k, (own - 1) % k])
        self.links = links

    def near(self, vectors: np.ndarray, beam: int, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the centroids a best-first walk meets (others are infinite) and to the nearest of them.

        All vectors walk at once, a few steps of each per round. A walk goes on while it has an unvisited centroid among
        its ``beam`` nearest or within ``reach`` times its nearest one.
        """
        k, n = len(self.centroids), len(vectors)
        beam, stride = min(beam, k), min(STRIDE, k)
        squares, own = (self.centroids**2).sum(axis=1), (vectors**2).sum(axis=1)
        seen = np.full((n, k), np.inf)
        seen[:, self.entries] = distances(vectors, self.centroids[self.entries])
        closed = np.zeros((n, k), bool)
        live = np.arange(n)
        while len(live):
            now = seen[live]
            edge = np.maximum(np.partition(now, beam - 1, axis=1)[:, beam - 1], reach * now.min(axis=1))
            waiting = np.where(closed[live] | (now > edge[:, None]), np.inf, now)
            best = np.argpartition(waiting, stride - 1, axis=1)[:, :stride]
            row, spot = np.nonzero(np.isfinite(np.take_along_axis(waiting, best, axis=1)))
            if not len(row):
                break
            centre = best[row, spot]
            closed[live[row], centre] = True
            code = np.unique((live[row][:, None] * k + self.links[centre]).ravel())
            r, c = code // k, code % k
            new = ~np.isfinite(seen[r, c])
            r, c = r[new], c[new]
            dots = np.einsum("nd,nd->n", vectors[r], self.centroids[c])
            seen[r, c] = np.sqrt(np.maximum(own[r] - 2 * dots + squares[c], 0))
            live = live[np.unique(row)]
        return seen, seen.min(axis=1)


def chosen_lists(graph: CentroidGraph, vectors: np.ndarray, search: Search) -> list[list[int]]:
    """Lists that hold each vector, nearest first: the nearest one and the others on whose border it lies."""
    seen, least = graph.near(vectors, search.beam)
    order = np.argsort(seen, axis=1, kind="stable")[:, : search.replicas]
    inside = np.take_along_axis(seen, order, axis=1) <= search.border * least[:, None] + 1e-12
    return [row[ok].tolist() for row, ok in zip(order, inside, strict=True)]


def probed_lists(graph: CentroidGraph, vectors: np.ndarray, search: Search) -> list[list[int]]:
    seen, least = graph.near(vectors, search.beam, search.reach)
    return [np.flatnonzero(row <= search.reach * d + 1e-12).tolist() for row, d in zip(seen, least, strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _with_lists(vectors: DataFrame, shared, pick, search: Search) -> DataFrame:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = pick(graph, _matrix(part.column(1)), search)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "embedding", "lists"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, lists array<int>")


def _best_of_block(k: int):
    def run(key: tuple, postings: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if postings.num_rows and queries.num_rows:
            ids = postings["vec_id"].to_numpy()
            block = _matrix(postings["embedding"].combine_chunks())
            asked = _matrix(queries["embedding"].combine_chunks())
            for query, vector in zip(queries["vec_id"].to_pylist(), asked, strict=True):
                d = np.sqrt(((block - vector) ** 2).sum(axis=1))
                d[ids == query] = np.inf
                edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                near = np.flatnonzero((d <= edge) & np.isfinite(d))
                near = near[np.lexsort((ids[near], d[near]))][:k]
                rows += [(query, int(ids[i]), float(d[i])) for i in near]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _found(postings: DataFrame, probes: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query over the blocks of its lists."""
    asked = probes.join(blocks, "list").select("vec_id", "embedding", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = postings.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInArrow(_best_of_block(k), "query_id long, vec_id long, score double")
    once = parts.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # replicas meet here
    spot = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", spot).where(F.col("rank") <= k)


def nearest_neighbours(
    table: DataFrame, is_query, k: int = 10, search: Search = Search(), id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, list_rows: int = LIST_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query, by Euclidean distance.

    ``is_query`` is a condition on ``vec_id``. Scores are exact distances in double precision; ties go to the smaller
    id. A query that finds fewer than ``k`` rows in its lists reads all lists, so it gets ``k`` or all candidates. See
    ``usable_vectors`` for rows that take no part; an empty table gives an empty result.
    """
    vectors = stored(usable_vectors(table, id_column, vector_column), "usable")
    n = rows_of(vectors)
    context = table.sparkSession.sparkContext
    lists = int(min(MAX_LISTS, max(1, n // list_rows)))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    points = _matrix(picked["embedding"].combine_chunks()) if n else np.zeros((1, 1))
    graph = CentroidGraph(bisected(points, min(lists, len(points))))
    shared = context.broadcast((graph.centroids, graph.links))  # made once; MAX_LISTS rows at most
    held = _with_lists(vectors, shared, chosen_lists, search).select("vec_id", "embedding", F.explode("lists").alias("list"))
    held = stored(held, "postings")
    blocks = stored(held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
    dealt = held.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    queries = vectors.where(is_query)
    probes = _with_lists(queries, shared, probed_lists, search).select("vec_id", "embedding", F.explode("lists").alias("list"))
    found = stored(_found(dealt, probes, blocks, k), "found")
    short = queries.join(found.groupBy("query_id").count().where(F.col("count") >= min(k, max(n - 1, 0))), F.col("vec_id") == F.col("query_id"), "left_anti")
    short = stored(short, "short")
    if n > 1 and rows_of(short):
        everywhere = short.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(graph.centroids) - 1))).alias("list"))
        again = _found(dealt, everywhere, blocks, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
