"""Periodic runs of words by an online, sparse form of the diagonal matches.

Word i matches word i - q on the diagonal of lag q. As the words come in, each earlier occurrence of a word adds one to the match
length of its lag, a lag that finds no match ends its diagonal, and a diagonal that ends with enough matches is a run: L matches
in a row at lag q are a stretch of L + q words with period q.

Following every earlier occurrence is quadratic (a text of one word has every lag active everywhere), and is not needed. Take
the words in contexts of k words, for k = 1, 2, 4, ...: a run of smallest period q, k / 2 < q <= k, has length 4q at
least, so it holds whole contexts, and the nearest earlier occurrence of such a context is exactly q words back: a nearer one would
give the context, and with it the run, a smaller period. So per k one lag is active at a time, that of the nearest earlier
occurrence of the context that ends at the word; its match length grows while the lag stays, and where it changes the
diagonal ends and the run is emitted. A stretch of exactly these matches has smallest period q, so no run is found at a multiple
of its period. Contexts that occur once are left out of all larger k, which ends the search early for most texts.

The state for a text is a few numbers per word; contexts are numbered exactly (pairs of numbers of the half contexts), so nothing
rests on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from prismtally.llm.common import raw_bytes


@dataclass(frozen=True)
class Runs:
    """A run has ``least`` words or more and holds its period ``repeats`` times or more (three at least)."""

    least: int = 6
    repeats: int = 4

    def __post_init__(self) -> None:
        if self.repeats < 3:
            raise ValueError("A run holds its period three times at least.")


def word_numbers(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


class Contexts:
    """The places (ends) whose context of ``size`` words occurs more than once in the text, with the number of that context."""

    def __init__(self, places: np.ndarray, numbers: np.ndarray, size: int, total: int) -> None:
        """Keeps the repeated contexts and notes the distance of each to its nearest earlier occurrence (0: none)."""
        order = np.argsort(numbers, kind="stable")
        same = numbers[order[1:]] == numbers[order[:-1]]
        repeated = np.zeros(len(places), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        back = np.zeros(len(places), np.int64)
        back[order[1:][same]] = (places[order[1:]] - places[order[:-1]])[same]
        self.size, self.total = size, total
        self.places, self.numbers, self.back = places[repeated], numbers[repeated], back[repeated]

    def doubled(self) -> Contexts:
        """Contexts of twice the size: those whose two halves are repeated."""
        at = np.searchsorted(self.places, self.places - self.size)
        at = np.minimum(at, max(len(self.places) - 1, 0))
        whole = self.places[at] == self.places - self.size if len(self.places) else np.zeros(0, bool)
        _, first = np.unique(self.numbers, return_inverse=True)
        pairs = first[at[whole]] * (len(self.numbers) + 1) + first[whole]
        return Contexts(self.places[whole], pairs, 2 * self.size, self.total)

    def diagonals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, last place and lag of each stretch of places in a row with one lag that this size answers for."""
        wanted = (self.back > self.size // 2) & (self.back <= self.size)
        places, lags = self.places[wanted], self.back[wanted]
        if not len(places):
            return places, places, lags
        ends = np.append((places[1:] != places[:-1] + 1) | (lags[1:] != lags[:-1]), True)
        last = np.flatnonzero(ends)
        first = np.append(0, last[:-1] + 1)
        return places[first], places[last], lags[first]


def periodic_runs(numbers: np.ndarray, wanted: Runs = Runs()) -> np.ndarray:
    """``start, length, period`` of each run, a row each, by start, then period."""
    n = len(numbers)
    found = [np.zeros((0, 3), np.int64)]
    contexts = Contexts(np.arange(n), numbers, 1, n)
    while len(contexts.places) and contexts.size < 2 * n:
        first, last, lags = contexts.diagonals()
        # The context of the first match begins at size - 1 words before it and its match lag words before that.
        start = first - contexts.size + 1 - lags
        length = last - start + 1
        enough = length >= np.maximum(wanted.least, wanted.repeats * lags)
        found.append(np.column_stack([start, length, lags])[enough])
        contexts = contexts.doubled()
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Marks the words that stay when every run is cut down to its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def strongest(runs: Column | str) -> Column:
    """The run that repeats most (exact length / period); ties go to the smallest start, then period. Null if there is none."""

    def more(top: Column, run: Column) -> Column:
        return F.when(top.isNull() | (run["length"] * top["period"] > top["length"] * run["period"]), run).otherwise(top)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), more)


def written(runs: Column | str) -> Column:
    """``start,length,period`` of each run on a line of its own."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


RESULT = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_runs(docs: DataFrame, text_column: str = "text", name: str = "found", wanted: Runs = Runs()) -> DataFrame:
    """``docs`` with ``name``: ``n_words``, ``runs`` (``start, length, period`` in words, by start, then period) and ``collapsed``, the
    words joined by one space without those that any run holds after its first period.

    Whole texts are read. A null, empty or blank text has no words, no runs and an empty ``collapsed``; repeated rows and null ids
    are rows like others; a column of that name is replaced. An empty table gives an empty result.
    """

    def one(text: bytes | None) -> dict:
        words = (text or b"").split()  # bytes.split cuts at the six ASCII blanks
        runs = periodic_runs(word_numbers(words), wanted)
        kept = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if len(runs) else words
        listed = [{"start": s, "length": m, "period": q} for s, m, q in runs.tolist()]
        return {"n_words": len(words), "runs": listed, "collapsed": b" ".join(kept).decode()}

    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(t) for t in raw_bytes(texts)], kind)

    return docs.withColumn(name, F.arrow_udf(run, RESULT, ArrowUDFType.SCALAR_ITER)(F.col(text_column).cast("string")))

