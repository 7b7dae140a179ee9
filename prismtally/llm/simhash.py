"""SimHash near-duplicates: fingerprints, Pigeonring candidates, links and their components.

A fingerprint has 64 bits. On a ring of ``m`` segments, two fingerprints that differ in at most ``t`` bits have
a start from which every chain of ``l`` consecutive segments differs in at most ``l * t / m`` bits (the strong
form of the pigeonring principle). The leading segments of such a chain whose budget is below one bit are equal,
so they are a key that Spark can join on; the budgets of the longer prefixes are conditions of that join, and the
full Hamming distance is the last check. No pair without that chain is ever formed.

Equal fingerprints are one node, so a group of copies costs one row however large it is. A key that many different
fingerprints share is keyed again on a second ring over the bits outside it, which loses nothing: the budget
holds there too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtally.llm.common import Batches, free_name, ordered_id, raw_bytes, row_key, stored
from prismtally.llm.components import components

BITS = 64
SEED = 42
SEGMENTS = 7
MAX_KEY_ROWS = 2000


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority bits over the XXH64 of all shingles; fewer words than a shingle are one; no word gives 0."""
    words = (text or b"").lower().split()  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: its id, ``rid`` (identity of the row) and ``fp``, the fingerprint as a signed 64-bit number.

    A null, empty or blank text has fingerprint 0. Other columns are not read.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in raw_bytes(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "rid", "fp"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text_column).alias("rid"), F.col(text_column).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, rid long, fp long")


def _segments(bits: list[int], count: int) -> list[list[int]]:
    """Bit positions of each segment of a ring over ``bits``."""
    return [list(map(int, part)) for part in np.array_split(np.array(bits), count)]


def _mask(positions: list[int]) -> int:
    value = sum(1 << p for p in positions)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _leading(segments: int, distance: int) -> int:
    """Segments at the head of a chain whose budget is below one bit."""
    return max(1, (segments - 1) // distance) if distance else segments


def _chain_fits(left: Column, right: Column, ring: list[list[int]], start: int, distance: int) -> Column:
    """Budgets of the prefixes of the chain that begins at ``start``, without those the join key settles."""
    m = len(ring)
    fits, seen = F.lit(True), []
    for length in range(1, m + 1):
        seen = seen + ring[(start + length - 1) % m]
        if length > _leading(m, distance):
            fits = fits & (F.bit_count(left.bitwiseXOR(right).bitwiseAND(F.lit(_mask(seen)))) <= length * distance // m)
    return fits


def _keyed(nodes: DataFrame, ring: list[list[int]], distance: int) -> DataFrame:
    """Each fingerprint once per start on the ring, with the bits of its leading segments."""
    m, head = len(ring), _leading(len(ring), distance)
    masks = [_mask([b for k in range(head) for b in ring[(s + k) % m]]) for s in range(m)]
    keys = F.array(*[F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(x)).alias("part")) for s, x in enumerate(masks)])
    return nodes.select("*", F.explode(keys).alias("k")).select(*nodes.columns, "k.start", "k.part")


def _matched(keyed: DataFrame, on: list[str], fits: Column, distance: int) -> DataFrame:
    left = keyed.select(*on, F.col("fp").alias("a"))
    right = keyed.select(*on, F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, on).where((F.col("a") > F.col("b")) & fits & close).select("a", "b")


def links(nodes: DataFrame, distance: int = 2, segments: int = SEGMENTS, max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """All pairs ``a > b`` of different fingerprints (column ``fp``, distinct) at ``distance`` or fewer bits."""
    if distance < 1:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    ring = _segments(list(range(BITS)), max(segments, distance + 1))
    m, head = len(ring), _leading(max(segments, distance + 1), distance)
    keyed = _keyed(nodes.select("fp"), ring, distance)
    crowded = keyed.groupBy("start", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_key_rows).select("start", "part")
    fits = F.lit(False)
    for s in range(m):
        fits = fits | ((F.col("start") == s) & _chain_fits(F.col("a"), F.col("b"), ring, s, distance))
    found = _matched(keyed.join(crowded, ["start", "part"], "left_anti"), ["start", "part"], fits, distance)

    # Crowded keys: all differing bits lie outside the key, so a ring over those bits keys the rows once more.
    hot = keyed.join(crowded, ["start", "part"], "left_semi")
    inner = [_segments([b for b in range(BITS) if b not in {x for k in range(head) for x in ring[(s + k) % m]}], m) for s in range(m)]
    picks = []
    for s in range(m):
        masks = [_mask([b for k in range(head) for b in inner[s][(i + k) % m]]) for i in range(m)]
        options = F.array(*[F.struct(F.lit(i).alias("inner"), F.col("fp").bitwiseAND(F.lit(x)).alias("rest")) for i, x in enumerate(masks)])
        picks.append((s, options))
    choice = F.when(F.col("start") == 0, picks[0][1])
    for s, options in picks[1:]:
        choice = choice.when(F.col("start") == s, options)
    finer = hot.select("*", F.explode(choice).alias("k")).select("fp", "start", "part", "k.inner", "k.rest")
    refined = _matched(finer, ["start", "part", "inner", "rest"], F.lit(True), distance)
    return found.unionAll(refined).distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 2, segments: int = SEGMENTS
) -> DataFrame:
    """Per document: ``doc_id``, ``rid``, ``fp``, ``root`` (a fingerprint that names its component) and ``component_id``, the
    smallest id that links reach from it.

    Null ids take part but are never the smallest; a component of null ids only has a null component_id. Rows that
    repeat an id are separate rows. An empty table gives an empty result.
    """
    marked = stored(fingerprints(docs, id_column, text_column, shingle), "simhash")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    star = components(links(nodes, distance, segments))
    rooted = stored(
        nodes.join(star, nodes["fp"] == star["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = rooted.select("fp", "root").join(smallest, "root")
    return marked.join(grouped, "fp").select("doc_id", "rid", "fp", "root", "component_id")


def one_per_group(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 2, segments: int = SEGMENTS
) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id.

    If several rows have that id, the one with the smallest row identity stays, and of rows that repeat in full, one.
    """
    rid = free_name(docs, "rid")
    found = near_duplicates(docs, id_column, text_column, shingle, distance, segments)
    keepers = found.groupBy("root").agg(F.min(F.struct(ordered_id("doc_id").alias("id"), F.col("rid"))).alias("k")).select(F.col("k.rid").alias(rid))
    kept = docs.withColumn(rid, row_key(id_column, text_column)).join(keepers, rid, "left_semi")
    return kept.dropDuplicates([rid]).drop(rid)


def hex_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
