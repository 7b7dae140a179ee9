"""Best-fit decreasing of documents into sequences of a fixed capacity.

Pieces are interchangeable but for their length, and lengths are at most the capacity. So best-fit decreasing runs on
the counts per length, however many documents there are: bins with equal room are one entry, a segment tree over
rooms finds the tightest room that takes a length in logarithmic time, and a run of equal pieces is placed in one
step. The plan that comes out is a few rows per length; pieces find their place in it by their rank among the pieces
of their length. Ranks come from counts per (length, salt), so the most frequent length is spread over tasks.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.llm.common import Batches, raw_bytes, rows_of, stored

CAPACITY = 1024
END = 2
ROWS_PER_SALT = 50_000
LEAST_SALTS = 32  # even a small table has a length that many pieces share
MEMO = 300_000


class RoomTree:
    """A segment tree over rooms 0..capacity; a leaf holds the runs of bins with that room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, value: bool) -> None:
        node = room + self.size
        self.some[node] = value
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def put(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def tightest(self, need: int) -> int:
        """The smallest room of at least ``need`` that an open bin has, or -1."""
        node = need + self.size
        if self.some[node]:
            return need
        while node > 1:  # up until a right neighbour has some, then down its left side
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, from_rank, to_rank, first_bin, per_bin, offset)``: ranks from..to of a length lie in bins from
    ``first_bin`` on, ``per_bin`` of them one after the other from ``offset``."""
    tree, bins, plan = RoomTree(capacity), 0, []
    for length in sorted((k for k in counts if k > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = tree.take(room)
            per = room // length  # equal pieces go on into the bin they have just made the tightest
            full = min(count, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                tree.put(room - per * length, first, full)
            if left and full < count:  # the last bin of the run is filled in part
                plan.append((length, rank, rank + left, first + full, left, capacity - room))
                tree.put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < count:
                tree.put(room, first + full, count - full)
    return plan


def placed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (column ``length``, 1..capacity) with ``sequence_id`` and ``offset``; all other columns stay.

    Only the counts of at most ``capacity`` lengths reach the driver. Ties of ``order`` are settled by row order in a
    window, and such rows may swap places.
    """
    pieces = stored(pieces, "pieces")
    salts = max(LEAST_SALTS, rows_of(pieces) // ROWS_PER_SALT)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = stored(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    upto = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt"))
    before = counts.select("length", "_salt", (upto - F.col("_n")).alias("_before"))
    spot = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = salted.withColumn("_spot", spot).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_spot") - 1)
    schema = "_length long, _from long, _to long, _bin long, _per long, _offset long"
    rows = best_fit_plan(totals, capacity)
    plan = pieces.sparkSession.createDataFrame(rows, schema)
    # The plan's size is bounded by the capacity, not by the data: a few runs per length.
    found = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    inside = F.col("_rank") - F.col("_from")
    return found.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(inside / F.col("_per"))).alias("sequence_id"),
        (F.col("_offset") + (inside % F.col("_per")) * F.col("length")).alias("offset"),
    )


def load_encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class PackedEncoder:
    """Token ids of a text as packed 32-bit numbers, with a bounded memo of the parts between single spaces.

    The pattern never joins text across a space that follows a visible character, so parts can be encoded on their own. A
    text where a space stands between or after other white space, or that spells a special token, is encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]) -> None:
        self.encoder = load_encoder(ranks_path, pattern)
        self.special = special
        self.memo: dict[str, bytes] = {}
        self.risky: set[str] = set()

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        packed = self.memo[part] = self._pack(self.encoder.encode_ordinary(" " + part))
        if not part or part[0].isspace() or part[-1].isspace():
            self.risky.add(part)
        return packed

    def whole(self, text: str) -> bytes:
        for name, number in self.special.items():
            if name in text:
                return self._pack([number]).join(self.whole(t) for t in text.split(name))
        return self._pack(self.encoder.encode_ordinary(text))

    def __call__(self, text: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
            self.risky.clear()
        first, *parts = text.split(" ")
        if any(name in text for name in self.special):
            return self.whole(text)
        memo, out = self.memo, []
        for part in parts:
            packed = memo.get(part)
            out.append(self._part(part) if packed is None else packed)
        if first[-1:].isspace() or (self.risky and not self.risky.isdisjoint(parts)):
            return self.whole(text)
        return self.whole(first) + b"".join(out)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``total`` ids: all full but the first."""
    head = total % capacity or capacity
    if total <= capacity:
        return [(0, total)]
    return [(0, head)] + [(at, capacity) for at in range(head, total, capacity)]


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ``ids`` themselves.

    A null text counts as empty: its one piece is the end id. Other columns are not read.
    """

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        encode = PackedEncoder(ranks_path, pattern, special)
        end = struct.pack("<I", END)
        for batch in batches:
            rows: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                packed = encode((raw or b"").decode("utf-8", "replace")) + end
                for piece, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                    part = packed[4 * start : 4 * (start + length)]
                    rows.append((key, piece, start, length, zlib.crc32(part), part))
                if len(rows) >= 4096:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array([struct.unpack(f"<{len(p) // 4}I", p) for p in cols[5]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)
