"""Files whose records may run across the byte ranges that Spark reads them by: quoted line breaks, JSON lists.

Spark's text source cuts a file into ranges and gives each task the pieces (parts of the file between separators) that begin in its range.
Whether a separator ends a record depends on all bytes before it, so the work goes in three scans, none of which reads a file in one task:

1. *Effects.* For every state that a range may begin in, a task finds the state it would end in. Effects are one row per range
   (Spark plans a task for each of them, so the driver holds as many already); composing them along a file gives every range its
   true state to begin with.
2. *Fragments.* A range knows now which of its pieces belong to a record that began before, or goes on behind it. These few
   are kept in a small table and put together by file and range.
3. *Records.* Every range gives the records that lie inside it. This scan is the result; it is as lazy as any reader.

Each scan plans its ranges anew; a range that the first scan has not seen is an error, never a wrong record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismtally.session import scratch_path

RECORD, HEAD, TAIL = 0, 1, 2
MARK = b"\xef\xbb\xbf"  # byte order mark


class Quoted:
    """Delimited text: pieces are lines, the state is whether a line begins inside a quoted field.

    A field is quoted if its first character behind blanks is a quote; a quote inside such a field is doubled; any other quote is a
    character like others.
    """

    separator = "\n"
    states = (0, 1)

    def __init__(self, delimiter: str, header: bool = True) -> None:
        d = re.escape(delimiter.encode())
        plain, quoted = rb'(?![ \t]*+")[^%b]*+' % d, rb'[^"]*+(?:""[^"]*+)*+"(?!")[^%b]*+' % d
        any_field = rb'(?>[ \t]*+"%b|%b)' % (quoted, plain) if delimiter != "\t" else rb'(?>[ ]*+"%b|%b)' % (quoted, plain.replace(rb"[ \t]", b"[ ]"))
        more = rb"(?:%b%b)*+" % (d, any_field)
        self._whole = re.compile(any_field + more, re.DOTALL)
        self._closed = re.compile(quoted + more, re.DOTALL)
        self.header = header

    @property
    def complete_line(self) -> str:
        """A pattern (also in Java) for lines that end outside of quotes if they begin there."""
        return rf"\A(?:{self._whole.pattern.decode()})\z"

    def after(self, state: int, line: bytes) -> int:
        if b'"' not in line:
            return state
        return 0 if (self._closed if state else self._whole).fullmatch(line) else 1

    def effect(self, state: int, pieces: Iterator[bytes]) -> tuple[int, int]:
        """End state and shift (none here) of a range."""
        for piece in pieces:
            state = self.after(state, piece)
        return state, 0

    def cut(self, state: int, shift: int, first: bool, pieces: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        """Records and fragments of a range that begins in ``state``; ``first``: the range begins a file."""
        kind, lines, header = (HEAD if state else RECORD), [], first and self.header
        for line in pieces:
            lines.append(line.removeprefix(MARK) if first and not lines else line)
            state = self.after(state, line)
            if not state:
                if header and kind == RECORD:
                    header = False
                elif kind == HEAD or any(x.strip() for x in lines):
                    yield kind, b"\n".join(lines)
                kind, lines = RECORD, []
        if lines:
            yield (TAIL if kind == RECORD else HEAD), b"\n".join(lines) + b"\n"


class Listed:
    """A JSON list: pieces end at a closing brace, the state is whether one begins inside a string, the shift is the nesting depth.

    The records are the objects at depth one.
    """

    separator = "}"
    states = (0, 1)
    _string = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
    _to_end = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.DOTALL)

    def step(self, state: int, piece: bytes) -> tuple[int, int]:
        """State and change of depth of a piece with the brace that ends it."""
        if state:
            end = self._to_end.match(piece)
            if not end:
                return 1, 0
            piece = piece[end.end() :]
        bare = self._string.sub(b"", piece) if b'"' in piece else piece
        open_, quote, _ = bare.partition(b'"')
        depth = open_.count(b"{") + open_.count(b"[") - open_.count(b"]") - open_.count(b"}")
        return (1, depth) if quote else (0, depth - 1)

    def effect(self, state: int, pieces: Iterator[bytes]) -> tuple[int, int]:
        shift = 0
        for piece in pieces:
            state, change = self.step(state, piece)
            shift += change
        return state, shift

    def cut(self, state: int, shift: int, first: bool, pieces: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        kind, parts = (HEAD if state or shift > 1 else RECORD), []
        for piece in pieces:
            if kind == RECORD and not parts:
                piece_state, change = self.step(state, piece)
                piece = piece.removeprefix(MARK) if first else piece
                lead, brace, rest = piece.partition(b"{")
                if not brace:  # behind the last record
                    state, shift = piece_state, shift + change
                    continue
                if lead.strip() not in (b"[", b","):
                    raise ValueError("A list of records holds something else between its objects.")
                parts.append(brace + rest)
            else:
                piece_state, change = self.step(state, piece)
                parts.append(piece)
            state, shift = piece_state, shift + change
            if not state and shift == 1:
                yield kind, b"}".join(parts) + b"}"
                kind, parts = RECORD, []
        if parts:
            yield (TAIL if kind == RECORD else HEAD), b"}".join(parts) + b"}"


@dataclass
class Ranges:
    """State and shift that every range (file, first byte) begins with, and the first visible bytes of the files."""

    begin: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    openings: set[bytes] = field(default_factory=set)


def pieces_of(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``value, file, start``: pieces in file order within a range."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[bytes]]]:
    """Groups the rows of a task by range; one range is read to its end before the next one comes."""
    waiting: list = []

    def rows() -> Iterator[tuple[tuple[int, int], bytes]]:
        for batch in batches:
            yield from zip(zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True), batch["value"].to_pylist(), strict=True)

    source = rows()

    def pieces(place: tuple[int, int], value: bytes) -> Iterator[bytes]:
        yield value
        for other, more in source:
            if other != place:
                waiting.append((other, more))
                return
            yield more

    for place, value in source:
        waiting.append((place, value))
        while waiting:
            place, value = waiting.pop()
            inside = pieces(place, value)
            yield place, inside
            for _ in inside:  # what the caller left
                pass


def effects(pieces: DataFrame, cutter: Quoted | Listed) -> Ranges:
    """The state of every range at its begin, by composing the effects of the ranges before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, inside in _by_range(batches):
            ends, opening = [(s, 0) for s in cutter.states], None
            for piece in inside:
                if opening is None:
                    opening = piece.removeprefix(MARK).strip()[:1] if place[1] == 0 else b""
                same = ends[0][0] == ends[1][0]
                (s0, d0), (s1, d1) = ends
                t0, c0 = cutter.effect(s0, iter((piece,)))
                t1, c1 = (t0, c0) if same else cutter.effect(s1, iter((piece,)))
                ends = [(t0, d0 + c0), (t1, d1 + c1)]
            yield pa.RecordBatch.from_pydict({"file": [place[0]], "start": [place[1]], "s0": [ends[0][0]], "d0": [ends[0][1]], "s1": [ends[1][0]], "d1": [ends[1][1]], "opening": [opening]})

    found = pieces.mapInArrow(run, "file long, start long, s0 long, d0 long, s1 long, d1 long, opening binary").collect()
    ranges, file, now = Ranges(), None, (0, 0)
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, now = r["file"], (0, 0)
            ranges.openings.add(bytes(r["opening"]))
        ranges.begin[file, r["start"]] = now
        state, change = (r["s1"], r["d1"]) if now[0] else (r["s0"], r["d0"])
        now = (state, now[1] + change)
    return ranges


def records(spark: SparkSession, path: str, cutter: Quoted | Listed, found: Ranges | None = None) -> DataFrame:
    """Every record of the files below ``path`` as ``record`` (bytes); ``found`` are their effects, if known."""
    pieces = pieces_of(spark, path, cutter.separator)
    known = spark.sparkContext.broadcast((found or effects(pieces, cutter)).begin)  # a few numbers per range that Spark plans

    def cut(wanted: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for place, inside in _by_range(batches):
                if place not in known.value:
                    raise ValueError("The byte ranges of the files changed between two scans; read them again.")
                held, size = [], 0
                for kind, record in cutter.cut(*known.value[place], place[1] == 0, inside):
                    if kind in wanted:
                        held.append((kind, record))
                        size += len(record)
                        if size > 1 << 22:
                            yield _batch(place, held)
                            held, size = [], 0
                if held:
                    yield _batch(place, held)

        return run

    schema = "file long, start long, kind int, record binary"
    scratch = scratch_path(spark, "fragments")
    pieces.mapInArrow(cut((HEAD, TAIL)), schema).write.parquet(scratch)
    fragments = spark.read.parquet(scratch)
    # A record over several ranges begins with the tail of one; the heads of the following ranges belong to it.
    along = Window.partitionBy("file").orderBy("start", "kind")
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(along)
    spanning = fragments.withColumn("number", number).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
    joined = spanning.select(F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["record"])).alias("record"))
    return pieces.mapInArrow(cut((RECORD,)), schema).select("record").unionAll(joined)


def _batch(place: tuple[int, int], held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    kinds, found = zip(*held, strict=True)
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([place[0]] * n, pa.int64()), pa.array([place[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(found, pa.binary())],
        names=["file", "start", "kind", "record"],
    )
