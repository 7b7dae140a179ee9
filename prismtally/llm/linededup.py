"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines chooses the lines that end a chunk, so an insertion or deletion moves
only the boundaries next to it and shared passages fall into the same chunks wherever they stand. A chunk of two or
more lines with words that an earlier document (or place) has too is removed; equal digests only make candidates, the
bytes are compared before anything goes.

With boundaries at a share of the lines (``deduplicated``) the first and last part of a passage share a chunk with other lines, so most short
passages stay. ``without_repeats``, which the query and the pipeline use, takes the smallest chunks at every line instead: a line with words and
the next one. Their union is every repeated run of two or more lines with words, whatever stands around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtally.llm.common import free_name, ordered_id, row_key, stored

WORDED = r"[^\x20\x09-\x0D]"  # found in a line with a word
DIVISOR = 3  # one line in so many ends a chunk
FACTOR = 31
SENT_ROWS, SENT_LINES = 1_000_000, 10_000_000  # removed numbers that are sent to all executors; more are joined by a shuffle


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def with_chunks(df: DataFrame, text: str, name: str, divisor: int = DIVISOR) -> DataFrame:
    """``df`` with ``name``: an array of ``lines`` (per chunk its own) for a text column; a null text is an empty line."""
    lines, hashes, ends = f"{name}_lines", f"{name}_hashes", f"{name}_ends"
    out = df.withColumn(lines, F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1))
    out = out.withColumn(hashes, F.transform(lines, line_hash))

    def closes(i: Column) -> Column:
        here, last = F.element_at(hashes, i), F.when(i > 1, F.element_at(hashes, F.greatest(i - 1, F.lit(1)))).otherwise(0)
        return (i == F.size(lines)) | ((here + FACTOR * last) % divisor == 0)

    out = out.withColumn(ends, F.filter(F.sequence(F.lit(1), F.size(lines)), closes))

    def piece(end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.element_at(ends, F.greatest(k, F.lit(1))) + 1).otherwise(1)
        return F.slice(lines, start, end - start + 1)

    return out.withColumn(name, F.transform(ends, piece)).drop(hashes, ends, lines)


def _many(chunk: Column) -> Column:
    """Whether a chunk has two or more lines with a word."""
    return F.size(F.filter(chunk, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) >= 2


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``rid`` (identity of a row) and ``removed``: the chunk numbers of it that an earlier place has byte by byte.

    Earlier means a smaller id, then a smaller row identity, then a smaller chunk number; a null id is the last of
    all. Rows that repeat in id and text are one place and treated alike.
    """
    base = docs.select(ordered_id(F.col(id_column).cast("long")).alias("doc"), row_key(id_column, text_column).alias("rid"), F.col(text_column).cast("string").alias("text"))
    place = F.struct("doc", "rid", "no")
    marks = with_chunks(base, "text", "chunks", divisor).select(
        "doc",
        "rid",
        F.explode(
            F.filter(F.transform("chunks", lambda c, k: F.when(_many(c), F.struct(k.alias("no"), F.unhex(F.md5(F.array_join(c, "\n"))).alias("digest")))), F.isnotnull)
        ).alias("c"),
    )
    marks = stored(marks.select("doc", "rid", "c.no", "c.digest"), "chunks")
    firsts = marks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    # Stored, so that both sides of the next join come from a shuffle of their own and a frequent chunk can be split.
    held = marks.join(stored(firsts, "first-chunks"), "digest")
    wanted = held.groupBy("rid").agg(F.collect_set(F.struct("no", "digest", (place == F.col("first")).alias("is_first"))).alias("wanted"))
    texts = (
        with_chunks(base.select("rid", "text").join(wanted, "rid"), "text", "chunks", divisor)
        .select("rid", F.explode("wanted").alias("w"), "chunks")
        .select("rid", "w.no", "w.digest", "w.is_first", F.array_join(F.element_at("chunks", F.col("w.no") + 1), "\n").alias("body"))
    )
    texts = stored(texts, "chunk-texts")
    # Rows that repeat in full give their first place more than once. Stored for the same reason as above.
    kept = stored(texts.where("is_first").select("digest", F.col("body").alias("first_body")).distinct(), "first-texts")
    same = texts.where("NOT is_first").join(kept, "digest").where("body = first_body")
    return stored(same.groupBy("rid").agg(F.collect_set("no").alias("removed")), "removed")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """``docs`` without its repeated chunks, with ``n_lines``, ``n_removed_chunks`` and ``n_removed_lines`` added.

    All rows and columns stay; a text without anything to remove is unchanged (null stays null), one that loses all its
    chunks is empty. If the table has columns of the added names, they are replaced. An empty table gives an empty result.
    """
    removed = repeated_chunks(docs, id_column, text_column, divisor)
    rid, gone, chunks = free_name(docs, "rid"), free_name(docs, "removed_numbers"), free_name(docs, "chunks")
    keyed = docs.withColumn(rid, row_key(id_column, text_column))
    joined = keyed.join(removed.select(F.col("rid").alias(rid), F.col("removed").alias(gone)), rid, "left")
    cut = with_chunks(joined, text_column, chunks, divisor)
    stays = F.filter(chunks, lambda c, k: ~F.array_contains(F.coalesce(F.col(gone), F.array().cast("array<int>")), k))
    lines = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda n, c: n + F.size(c))
    return (
        cut.withColumn("n_lines", lines(F.col(chunks)))
        .withColumn("n_removed_chunks", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn("n_removed_lines", F.col("n_lines") - lines(stays))
        .withColumn(text_column, F.when(F.col(gone).isNull(), F.col(text_column)).otherwise(F.array_join(F.flatten(stays), "\n")))
        .drop(rid, gone, chunks)
    )


def with_passages(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``first`` and ``last`` line (from 1) of each line with a word and the next one, and the ``body`` between."""
    lines, worded = f"{name}_lines", f"{name}_worded"
    out = df.withColumn(lines, F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1))
    out = out.withColumn(worded, F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(WORDED)))

    def passage(last: Column, k: Column) -> Column:
        first = F.element_at(worded, F.greatest(k, F.lit(1)))
        body = F.array_join(F.slice(lines, first, last - first + 1), "\n")
        return F.when(k > 0, F.struct(k.alias("no"), first.alias("first"), last.alias("last"), body.alias("body")))

    return out.withColumn(name, F.filter(F.transform(worded, passage), F.isnotnull)).drop(lines, worded)


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``rid`` and ``removed``: the numbers (from 1) of its lines in runs of two or more lines with words that an earlier place has.

    Each run is the union of its passages from a line with words to the next one, so all such runs are found, whatever
    stands around them. Earlier is as in ``repeated_chunks``; where a passage overlaps its own first place, that stays.
    """
    base = docs.select(ordered_id(F.col(id_column).cast("long")).alias("doc"), row_key(id_column, text_column).alias("rid"), F.col(text_column).cast("string").alias("text"))
    place = F.struct("doc", "rid", "no")
    # An inner explode would push a filter on the passages to the scan, which splits the text again for each of its lines.
    marks = with_passages(base, "text", "passages").select("doc", "rid", F.explode_outer("passages").alias("p"))
    marks = stored(marks.where("p IS NOT NULL").select("doc", "rid", "p.no", F.unhex(F.md5("p.body")).alias("digest")), "passages")
    firsts = marks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    # Stored at each step, so that both sides of a join come from a shuffle of their own and a frequent passage can be split.
    held = marks.join(stored(firsts, "first-passages"), "digest")
    overlaps = (F.col("rid") == F.col("first.rid")) & (F.col("no") == F.col("first.no") + 1)
    mark = F.struct("no", "digest", (place == F.col("first")).alias("is_first"), overlaps.alias("overlaps"))
    wanted = held.groupBy("rid").agg(F.collect_set(mark).alias("wanted"))
    texts = with_passages(base.select("rid", "text").join(wanted, "rid"), "text", "passages")
    found = F.transform("wanted", lambda w: F.struct(w["digest"].alias("digest"), w["is_first"].alias("is_first"), w["overlaps"].alias("overlaps"), F.element_at("passages", w["no"]).alias("p")))
    texts = texts.select("rid", F.explode_outer(found).alias("w")).select("rid", "w.digest", "w.is_first", (F.col("w.p.first") + F.col("w.overlaps").cast("int")).alias("first"), "w.p.last", "w.p.body")
    texts = stored(texts, "passage-texts")
    kept = stored(texts.where("is_first").select("digest", F.col("body").alias("first_body")).distinct(), "first-texts")
    same = texts.where("NOT is_first").join(kept, "digest").where("body = first_body")
    return stored(same.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("removed")), "removed")


def _is_small(removed: DataFrame) -> bool:
    """Whether the removed numbers take some 80 MB at most, so that texts need no shuffle to meet them."""
    rows, lines = removed.agg(F.count(F.lit(1)), F.sum(F.size("removed"))).first()
    return rows <= SENT_ROWS and (lines or 0) <= SENT_LINES


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count: str = "n_removed_lines") -> DataFrame:
    """``docs`` without the lines of ``repeated_lines``, with their number as ``count`` added (a column of that name is replaced).

    All rows stay; a text without anything to remove is unchanged, one that loses all its lines is empty.
    """
    removed = repeated_lines(docs, id_column, text_column)
    rid, gone, lines = free_name(docs, "rid"), free_name(docs, "removed_numbers"), free_name(docs, "lines")
    keyed = docs.withColumn(rid, row_key(id_column, text_column))
    numbers = removed.select(F.col("rid").alias(rid), F.col("removed").alias(gone))
    joined = keyed.join(F.broadcast(numbers) if _is_small(removed) else numbers, rid, "left")
    cut = joined.withColumn(lines, F.split(F.coalesce(F.col(text_column).cast("string"), F.lit("")), "\n", -1))
    stays = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(gone)), lambda i: F.element_at(lines, i))
    return (
        cut.withColumn(count, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn(text_column, F.when(F.col(gone).isNull(), F.col(text_column)).otherwise(F.array_join(stays, "\n")))
        .drop(rid, gone, lines)
    )


def cleaned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """``docs`` without repeated runs of lines and without the documents that this leaves without a word; same columns.

    ``size_column``, if there is one, follows the text. A copy whose lines all stand in an earlier document is no document any more; a
    text that had no word before stays.
    """
    count = free_name(docs, "n_removed_lines")
    out = without_repeats(docs, id_column, text_column, count)
    if size_column in docs.columns:
        out = out.withColumn(size_column, F.when(F.col(count) > 0, F.length(text_column).cast("long")).otherwise(F.col(size_column)))
    return out.where((F.col(count) == 0) | F.col(text_column).rlike(WORDED)).select(*docs.columns)
