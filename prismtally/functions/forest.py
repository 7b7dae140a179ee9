"""Random forests for several targets at once, fitted on all rows.

A tree sees a row only by its bins, so it is grown on cells: the different combinations of bins, each with the number of rows drawn from it and
the sum of their values. Equal rows (one cell, one value of the target) are counted first. A bucket of them, dealt by a hash, draws the bags of
all trees: a row is drawn as often as a Poisson number of mean 1 says, so equal rows are drawn together. The draws follow from the rows alone and
are the same on any cluster. The cells of a tree meet in one task, which grows it level by level without a limit of depth: one histogram per
feature holds the sums of the open nodes of a level, and the best cut of every node is read off their running sums. Cells a tree has not drawn are
routed too, so that the forest's predictions are those of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtally.session import scratch_path

BINS = 64
BUCKET_ROWS = 200_000  # different rows that draw their bags together
MOST_SUMS = 4_000_000  # of nodes times bins that a level holds at a time
BATCH_BYTES, BATCH_CELLS = 4 << 20, 50_000
CODE, CODES = np.dtype("<u2"), 4  # a bin or a category of a cell; so many of them in a long


@dataclass
class Category:
    """``values`` of a text ``column`` in order; a missing one is ``fill``. One feature per value."""

    column: str
    values: list[str]
    fill: str
    owner: str

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        found = pc.index_in(batch.column(self.column), value_set=pa.array(self.values, pa.string()))
        return pc.fill_null(found, self.values.index(self.fill)).to_numpy(zero_copy_only=False)

    def sizes(self) -> list[int]:
        return [2] * len(self.values)

    def features(self, codes: np.ndarray) -> list[np.ndarray]:
        return [(codes == k).astype(CODE) for k in range(len(self.values))]


@dataclass
class Number:
    """Values of a ``column`` in bins that end at the ``cuts``; a missing one is ``fill``."""

    column: str
    cuts: np.ndarray
    fill: float
    owner: str

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        values = batch.column(self.column).to_numpy(zero_copy_only=False)
        return np.searchsorted(self.cuts, np.where(np.isnan(values), self.fill, values), side="left")

    def sizes(self) -> list[int]:
        return [len(self.cuts) + 1]

    def features(self, codes: np.ndarray) -> list[np.ndarray]:
        return [codes]


@dataclass
class Target:
    """A ``column`` to be modelled, where it is known, by its features."""

    column: str
    features: list[Category | Number]

    def owners(self) -> list[str]:
        return [f.owner for f in self.features for _ in f.sizes()]


def best_cuts(bins: np.ndarray, sizes: list[int], w: np.ndarray, wy: np.ndarray, node: np.ndarray, nodes: int, leaf: int) -> tuple[np.ndarray, ...]:
    """Per node the gain, feature and last bin on the left of its best cut (feature -1: none), and its mean."""
    count, total = np.bincount(node, w, nodes), np.bincount(node, wy, nodes)
    base = total * total / np.maximum(count, 1e-300)
    best, feature, cut = np.full(nodes, 0.0), np.full(nodes, -1), np.zeros(nodes, np.int64)
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        code = node * size + bins[:, f]
        left = np.bincount(code, w, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1]
        left_sum = np.bincount(code, wy, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1]
        right, right_sum = count[:, None] - left, total[:, None] - left_sum
        fits = (left >= leaf) & (right >= leaf)
        with np.errstate(all="ignore"):
            gain = np.where(fits, left_sum**2 / left + right_sum**2 / right - base[:, None], -np.inf)
        at = gain.argmax(axis=1)
        top = gain[np.arange(nodes), at]
        better = top > best * (1 + 1e-12) + 1e-12 * np.abs(base)
        best[better], feature[better], cut[better] = top[better], f, at[better]
    return best, feature, cut, total / np.maximum(count, 1e-300)


def grown(bins: np.ndarray, sizes: list[int], y: np.ndarray, drawn: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """One tree: the gain of each feature and the prediction for each row; ``drawn`` says how often a row is in the bag."""
    gains, predicted = np.zeros(bins.shape[1]), np.zeros(len(y))
    rows, node, nodes = np.arange(len(y)), np.zeros(len(y), np.int64), 1
    step = max(1, MOST_SUMS // max(sizes, default=1))
    while len(rows):
        if nodes > step:
            order = np.argsort(node, kind="stable")
            rows, node = rows[order], node[order]
        parts = []
        for low in range(0, nodes, step):
            some = slice(*np.searchsorted(node, [low, low + step])) if nodes > step else slice(None)
            w = drawn[rows[some]].astype(np.float64)
            parts.append(best_cuts(bins[rows[some]], sizes, w, w * y[rows[some]], node[some] - low, min(step, nodes - low), leaf))
        best, feature, cut, means = (np.concatenate(p) for p in zip(*parts, strict=True))
        split = feature >= 0
        np.add.at(gains, feature[split], best[split])
        done = ~split[node]
        predicted[rows[done]] = means[node[done]]
        rows, node = rows[~done], node[~done]
        number = np.cumsum(split) - 1
        right_side = bins[rows, feature[node]] > cut[node]
        node = 2 * number[node] + right_side
        nodes = 2 * int(split.sum())
    return gains, predicted


def _words(targets: list[Target]) -> list[str]:
    """The long columns that name a cell; a target with fewer features leaves the rest zero."""
    return [f"c{k}" for k in range(max(-(-len(t.features) // CODES) for t in targets))]


def _unique(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of a matrix of longs, in order, and which of them each row is."""
    found, at = np.unique(np.ascontiguousarray(words).view(f"S{words.dtype.itemsize * words.shape[1]}").ravel(), return_inverse=True)
    return found.view(np.int64).reshape(len(found), words.shape[1]), at


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Binary values one after another as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def equal_rows(rows: DataFrame, targets: list[Target]) -> DataFrame:
    """``target`` (its place), the words of the cell, ``y`` and ``n``: how many of the ``rows`` are the same to the model."""
    words = _words(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: dict[int, np.ndarray] = {}
            for place, t in enumerate(targets):
                y = batch.column(t.column)
                known = y.is_valid()
                for f in t.features:
                    if id(f) not in codes:  # targets without gaps share their features
                        codes[id(f)] = f.codes(batch).astype(CODE)
                cells = np.zeros((batch.num_rows, CODES * len(words)), CODE)
                for k, f in enumerate(t.features):
                    cells[:, k] = codes[id(f)]
                cells = cells.view(np.int64)[known.to_numpy(zero_copy_only=False)]
                columns = [pa.array(np.full(len(cells), place, np.int32)), *[pa.array(c) for c in cells.T], y.filter(known)]
                yield pa.RecordBatch.from_arrays(columns, names=["target", *words, "y"])

    coded = rows.mapInArrow(run, f"target int, {', '.join(f'{w} long' for w in words)}, y double")
    path = scratch_path(rows.sparkSession, "forest-rows")
    coded.groupBy("target", *words, "y").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def bags(equal: DataFrame, targets: list[Target], buckets: dict[int, int], means: dict[int, float], trees: int, seed: int) -> DataFrame:
    """Per ``target``, ``tree`` and bucket of rows: its ``cells``, and of each the number (``w``) and sum (``wy``) of the rows drawn."""
    words = _words(targets)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bucket = (k.as_py() for k in key)
        table = pa.Table.from_batches(batches)
        cells, cell = _unique(np.column_stack([table[c].to_numpy() for c in words]))
        y, n = table["y"].to_numpy(), table["n"].to_numpy()
        order = np.lexsort((y, cell))
        y, n, cell = y[order] - means[place], n[order], cell[order]
        found: list[tuple[int, int, bytes, bytes, bytes]] = []
        for tree in range(trees):
            w = np.random.default_rng((seed, place, tree, bucket)).poisson(n)
            count, total = np.bincount(cell, w, len(cells)), np.bincount(cell, w * y, len(cells))
            found.append((place, tree, cells.tobytes(), count.tobytes(), total.tobytes()))
            if sum(len(b) for row in found for b in row[2:]) > BATCH_BYTES or tree == trees - 1:
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32(), pa.int32()] + [pa.binary()] * 3, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["target", "tree", "cells", "w", "wy"])
                found = []

    bucket = F.pmod(F.xxhash64(*words, "y"), F.element_at(F.array(*[F.lit(buckets.get(k, 1)) for k in range(len(targets))]), F.col("target") + 1))
    dealt = equal.withColumn("bucket", bucket.cast("int"))
    dealt = dealt.repartition(_parts(equal, sum(buckets.values())), "target", "bucket")
    return dealt.groupBy("target", "bucket").applyInArrow(run, "target int, tree int, cells binary, w binary, wy binary")


def _parts(df: DataFrame, groups: int) -> int:
    """Tasks for so many groups, which adaptive planning would put into one where they hold few bytes."""
    return max(1, min(groups, max(8, 4 * df.sparkSession.sparkContext.defaultParallelism)))


def grown_trees(drawn: DataFrame, targets: list[Target], trees: int, leaf: int) -> DataFrame:
    """Per ``target`` and tree a row with the ``gains`` of the features (they sum to 1), and a row per cell with its words and prediction ``p``."""
    words = _words(targets)
    names = ["target", *words, "p", "gains"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = key[0].as_py()
        features = targets[place].features
        table = pa.Table.from_batches(batches)
        cells, cell = _unique(_joined(table["cells"], np.int64).reshape(-1, len(words)))
        w, wy = (np.bincount(cell, _joined(table[c], np.float64), len(cells)) for c in ("w", "wy"))
        codes = cells.view(CODE)
        bins = np.column_stack([column for k, f in enumerate(features) for column in f.features(codes[:, k])])
        gain, guess = grown(bins, [s for f in features for s in f.sizes()], wy / np.maximum(w, 1), w, leaf)
        first = [pa.array([place], pa.int32()), *[pa.nulls(1, pa.int64()) for _ in words], pa.nulls(1, pa.float64()), pa.array([gain / max(gain.sum(), 1e-300)], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(first, names=names)
        for at in range(0, len(cells), BATCH_CELLS):
            some, p = cells[at : at + BATCH_CELLS], guess[at : at + BATCH_CELLS]
            columns = [pa.array(np.full(len(p), place, np.int32)), *[pa.array(c) for c in some.T], pa.array(p), pa.nulls(len(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    dealt = drawn.repartition(_parts(drawn, len(targets) * trees), "target", "tree")
    path = scratch_path(drawn.sparkSession, "forest-trees")
    dealt.groupBy("target", "tree").applyInArrow(run, f"target int, {', '.join(f'{w} long' for w in words)}, p double, gains array<double>").write.parquet(path)
    return drawn.sparkSession.read.parquet(path)


def fit_forests(rows: DataFrame, targets: list[Target], trees: int, leaf: int, seed: int) -> list[tuple[dict[str, float], float]]:
    """Per target the importance of each column (sums to 1, mean over the trees) and R squared over its rows."""
    if not targets:
        return []
    equal = equal_rows(rows, targets)
    facts = equal.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean")).collect()
    buckets, means = {r["target"]: -(-r["rows"] // BUCKET_ROWS) for r in facts}, {r["target"]: r["mean"] for r in facts}
    found = grown_trees(bags(equal, targets, buckets, means, trees, seed), targets, trees, leaf)

    shares = found.select("target", F.posexplode("gains").alias("feature", "gain")).groupBy("target", "feature").agg(F.sum("gain").alias("gain")).collect()
    off = F.col("y") - F.element_at(F.array(*[F.lit(float(means.get(k, 0.0))) for k in range(len(targets))]), F.col("target") + 1)
    zero = F.lit(0.0)
    cell = ["target", *_words(targets)]
    cells = equal.select(*cell, zero.alias("p"), "n", (F.col("n") * off).alias("s"), (F.col("n") * off * off).alias("ss")).unionByName(
        found.where("gains IS NULL").select(*cell, "p", F.lit(0).cast("long").alias("n"), zero.alias("s"), zero.alias("ss"))
    )
    cells = cells.groupBy(*cell).agg((F.sum("p") / trees).alias("p"), *[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    p, n, s, ss = F.col("p"), F.col("n"), F.col("s"), F.col("ss")
    sums = cells.groupBy("target").agg(F.sum(F.greatest(ss - 2 * p * s + n * p * p, zero)).alias("residual"), (F.sum(ss) - F.sum(s) * F.sum(s) / F.sum(n)).alias("spread")).collect()

    out: list[tuple[dict[str, float], float]] = []
    for place, target in enumerate(targets):
        gains = {r["feature"]: r["gain"] for r in shares if r["target"] == place}
        whole = max(sum(gains.values()), 1e-300)
        importance: dict[str, float] = {}
        for feature, owner in enumerate(target.owners()):
            importance[owner] = importance.get(owner, 0.0) + gains.get(feature, 0.0) / whole
        residual, spread = next(((r["residual"], r["spread"]) for r in sums if r["target"] == place), (0.0, 0.0))
        out.append((importance, float(1 - residual / spread) if spread > 0 else 0.0))
    return out
