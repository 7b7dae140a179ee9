"""Substring dedup: words covered by long windows that an earlier document also has.

Documents are cut where the smallest hash among the word n-grams of a window changes. All windows with one such hash go
to one shard, so equal windows meet and nothing is compared with every shard. Hashes that only one document has
are dropped at once; equal pieces are one row. Each shard of the rest gets an FM-index (suffix order, wavelet matrix
over the last column, LCP intervals); its pieces are streamed through a backward search that keeps, for every word,
the longest match in a piece of a smaller document, and matches of a window or more are reported as intervals.

Pieces of one hash that are too many for an index go by whole windows instead, in a grouping that Spark can spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtally.llm.common import Batches, free_name, ordered_id, raw_bytes, row_key, stored
from prismtally.llm.fmindex import FMIndex

WINDOW = 50
GRAM = 20
SHARD_WORDS = 150_000
MAX_KEY_WORDS = 1_500_000
MIX = 0x9E3779B97F4A7C15


def window_keys(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest n-gram hash of each window."""
    with np.errstate(over="ignore"):
        m = len(hashes) - gram + 1
        rolled = np.zeros(m, np.uint64)
        for k in range(gram):
            rolled = rolled * np.uint64(MIX) + hashes[k : k + m]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(27)
    width, span, low = window - gram + 1, 1, rolled
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def spans_of(words: list[bytes]) -> tuple[list[int], list[int]]:
    """Start and end of each word in the words joined by one space."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return [0, *(ends[:-1] + 1).tolist()], ends.tolist()


def pieces_of(words: list[bytes], window: int, gram: int) -> list[tuple[int, int, int, int]]:
    """``(key, content, start, words)`` of each run of windows that share a key."""
    if len(words) < window:
        return []
    keys = window_keys(word_hashes(words), window, gram)
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    left, right = spans_of(words)
    text, out = b" ".join(words), []
    signed = keys.view(np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        body = text[left[a] : right[b + window - 2]]
        out.append((int(signed[a]), int.from_bytes(xxhash.xxh64_digest(body), "big", signed=True), a, b - a + window - 1))
    return out


def _base(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        ordered_id(F.col(id_column).cast("long")).alias("doc"), row_key(id_column, text_column).alias("rid"), F.col(text_column).cast("string").alias("text")
    )


def _pieces(base: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(6)]
            docs, rids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, rid, raw in zip(docs, rids, raw_bytes(batch.column(2)), strict=True):
                for row in pieces_of((raw or b"").split(), window, gram):
                    for col, value in zip(cols, (doc, rid, *row), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "rid", "key", "content", "start", "words"])

    return base.mapInArrow(run, "doc long, rid long, key long, content long, start long, words long")


def _bodies(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text of one example of each wanted piece: ``key, content, doc, words, body``."""
    per_row = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "content", "doc", "start", "words")).alias("wanted"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, pieces in zip(raw_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = (raw or b"").split()
                rows += [(p["key"], p["content"], p["doc"], p["words"], b" ".join(words[p["start"] : p["start"] + p["words"]])) for p in pieces]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "content", "doc", "words", "body"])

    texts = base.select("rid", "text").join(per_row, "rid").select("text", "wanted")
    # Rows that repeat in id and text give the same example more than once.
    return texts.mapInArrow(run, "key long, content long, doc long, words long, body binary").dropDuplicates(["key", "content"])


def search_shard(bodies: list[bytes], docs: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each piece of a shard, ``(offset, words)`` of what a piece of a smaller document also has."""
    codes: dict[bytes, int] = {}
    patterns = [np.array([codes.setdefault(w, len(codes) + 1) for w in body.split()], np.int64) for body in bodies]
    owners = np.unique(np.array(docs, np.int64), return_inverse=True)[1].astype(np.int32)
    text = np.concatenate([part for p in patterns for part in (p, np.zeros(1, np.int64))])
    owner = np.repeat(owners, [len(p) + 1 for p in patterns])
    index = FMIndex(text, owner, max(map(len, patterns)))
    out = []
    for longest in index.matching_statistics(patterns, owners):
        found: list[tuple[int, int]] = []
        for at in np.flatnonzero(longest >= window).tolist():
            end = at + int(longest[at])
            if found and at <= found[-1][0] + found[-1][1]:
                start = found[-1][0]
                found[-1] = (start, max(end, start + found[-1][1]) - start)
            else:
                found.append((at, end - at))
        out.append(found)
    return out


def _indexed(bodies: DataFrame, shards: int, window: int) -> DataFrame:
    """Intervals per piece, from one FM-index per shard."""

    def run(group: pa.Table) -> pa.Table:
        ordered = group.sort_by([("key", "ascending"), ("content", "ascending")])
        found = search_shard(ordered["body"].to_pylist(), ordered["doc"].to_pylist(), window)
        rows = [(k, c, at, n) for k, c, f in zip(ordered["key"].to_pylist(), ordered["content"].to_pylist(), found, strict=True) for at, n in f]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["key", "content", "at", "n"])

    sharded = bodies.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "content", "doc", "body")
    return sharded.groupBy("shard").applyInArrow(run, "key long, content long, at long, n long")


def _by_windows(bodies: DataFrame, window: int) -> DataFrame:
    """The same intervals for crowded keys: windows by a 128-bit hash, grouped with partial minima."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, content, doc, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                left, right = spans_of(body.split())
                for at in range(len(left) - window + 1):
                    rows.append((key, content, doc, at, xxhash.xxh128_digest(body[left[at] : right[at + window - 1]])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "content", "doc", "at", "hash"])

    windows = bodies.select("key", "content", "doc", "body").mapInArrow(run, "key long, content long, doc long, at long, hash binary")
    windows = stored(windows, "windows")
    least = windows.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("hash", "least")
    return windows.join(least, "hash").where("least < doc").select("key", "content", "at", F.lit(window).cast("long").alias("n"))


def repeated_intervals(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM, max_key_words: int = MAX_KEY_WORDS
) -> DataFrame:
    """``rid`` and ``spans`` (array of ``at``, ``n``): words of a row in windows that start in a document with a smaller id.

    A null id is larger than all others; rows with equal ids do not remove each other's words; rows that repeat in id and
    text share their spans. Memory per task is one shard: about ``SHARD_WORDS`` words, or one key of ``max_key_words``.
    """
    gram = min(gram, window)
    base = _base(docs, id_column, text_column)
    pieces = stored(_pieces(base, window, gram), "pieces")
    shared = pieces.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key")
    # Stored, so that both sides of the join come from a shuffle of their own and a frequent key can be split.
    pieces = stored(pieces.join(stored(shared, "shared-keys"), "key"), "shared-pieces")
    contents = pieces.groupBy("key", "content").agg(
        F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min(F.struct("doc", "rid", "start", "words")).alias("example")
    )
    contents = stored(contents, "contents")
    per_key = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("example.words").alias("words")).where("kinds > 1")
    per_key = stored(per_key.select("key", "words"), "keys")
    several = contents.join(per_key.select("key", F.col("words").alias("key_words")), "key")
    wanted = several.select("key", "content", "doc", "key_words", "example.rid", "example.start", "example.words")
    bodies = stored(_bodies(base, wanted.drop("key_words")), "bodies")
    crowded = per_key.where(F.col("words") > max_key_words).select("key")
    total = per_key.where(F.col("words") <= max_key_words).agg(F.sum("words")).first()[0] or 0
    indexed = _indexed(bodies.join(crowded, "key", "left_anti"), int(total // SHARD_WORDS) + 1, window)
    found = indexed.unionAll(_by_windows(bodies.join(crowded, "key", "left_semi"), window))
    found = stored(found, "intervals")

    # An occurrence in a later document than the first of its piece goes whole; the first one by what the search found.
    later = pieces.join(contents.select("key", "content", F.col("doc").alias("first"), "last").where("first < last"), ["key", "content"]).where("doc > first")
    whole = later.select("rid", F.col("start").alias("at"), F.col("words").alias("n"))
    leading = pieces.join(contents.select("key", "content", "doc"), ["key", "content", "doc"]).join(found, ["key", "content"])
    partly = leading.select("rid", (F.col("start") + F.col("at")).alias("at"), "n")
    return stored(whole.unionAll(partly).groupBy("rid").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text`` and the removed ``spans``.

    Kept words are joined by one space; a null text has no words. An empty table gives an empty result. Extra columns
    are not read.
    """
    spans = repeated_intervals(docs, id_column, text_column, window)
    rid = free_name(docs, "rid")
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text_column).alias(rid), F.col(text_column).cast("string").alias("text"))
    joined = slim.join(spans.withColumnRenamed("rid", rid), rid, "left").select("doc_id", "text", "spans")

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw, cut in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (raw or b"").split()
                gone = np.zeros(len(words), bool)
                for s in cut or ():
                    gone[s["at"] : s["at"] + s["n"]] = True
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if cut else b" ".join(words)
                rows.append((key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None, cut))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            if with_text:
                arrays += [pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept_text", "spans"] if with_text else [])
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", kept_text string, spans array<struct<at: long, n: long>>"
    return joined.mapInArrow(run, schema)
