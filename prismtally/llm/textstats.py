"""Statistics of whole texts, one pass, for the quality rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtally.llm.common import Batches, raw_bytes

BLANKS = b" \t\n\r\x0b\x0c"
TAILS = bytes(range(0x80, 0xC0))  # UTF-8 continuation bytes: every other byte begins a code point
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
ENDINGS = b".!?"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_endings",
)
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words whose sequence is found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    window = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            window = (window ^ single[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    raw = text or b""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    without = lambda dropped: len(raw) - len(raw.translate(None, dropped))
    return (
        len(words),
        len(raw.translate(None, BLANKS + TAILS)),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        len(lines),
        without(UPPER),
        without(LOWER),
        without(DIGITS),
        without(ENDINGS),
    )


def counts_of(texts: pa.Array) -> list[pa.Array]:
    found = np.array([text_counts(t) for t in raw_bytes(texts)], np.int64).reshape(len(texts), len(COUNTS))
    return [pa.array(found[:, k].copy()) for k in range(len(COUNTS))]


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with the counts of its whole text; a null text counts as an empty one."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts_of(batch.column(1))], names=["doc_id", *COUNTS])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def statistics_column(text: Column) -> Column:
    """The same counts as one struct column, for frames that keep their other columns."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(counts_of(texts), names=list(COUNTS))

    return F.arrow_udf(run, "struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ">")(text)
