"""File readers (S1-S6) and JSON flattening."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import col
from prismtally.operators.prepare import infer_text_types
from prismtally.session import scratch_path
from prismtally.sources import spanning
from prismtally.sources.sqlite import read_sqlite
from prismtally.sources.writers import csv_options

# File extensions by reader and the separators tried.
DELIMITED, JSON_LINES, JSON, PARQUET = ("csv", "tsv"), ("jsonl", "ndjson"), ("json",), ("parquet",)
SQLITE = ("db", "sqlite", "sqlite3")
SEPARATORS = (",", ";", "\t", "|")
OVERFLOW = "__extra_field"
FALLBACK_ENCODING = "ISO-8859-1"


def read_dataset(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    table: str | None = None,
    sep: str | None = None,
    encoding: str | None = None,
    infer: bool = True,
    **csv,
) -> DataFrame:
    """Read by extension (or ``file_format`` where a folder name carries none); ``csv`` goes to ``read_delimited``."""
    kind = (file_format or PurePosixPath(path.rstrip("/")).suffix.lstrip(".")).lower()
    if kind in DELIMITED:
        return read_delimited(spark, path, "\t" if kind == "tsv" else sep, encoding, infer, **csv)
    if kind in JSON_LINES:
        return flatten_structs(spark.read.option("encoding", encoding or text_encoding(spark, path)).json(path))
    if kind in JSON:
        return read_json(spark, path, encoding)
    if kind in PARQUET:
        return spark.read.parquet(path)
    if kind in SQLITE:
        return read_sqlite(spark, path, table)
    raise ValueError(f"Unsupported file format: {kind}")


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid in it, else a one-byte encoding. One scan; name the encoding to save it."""
    odd = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if odd.isEmpty() else FALLBACK_ENCODING


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Physical lines as ``value``, decoded like the reader decodes them."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.option("lineSep", "\n").text(path)
    whole = {"sep": "\u0001", "quote": "", "encoding": encoding, "lineSep": "\n"}
    return spark.read.options(**whole).schema("value string").csv(path)


def guess_separator(lines: DataFrame, header: str) -> str:
    """The separator that splits most lines into as many fields as the header, most fields first.

    One aggregate over all lines (``value``), so no sample decides; quoted parts of a line do not count.
    """

    def fields(text) -> dict[str, int]:
        bare = F.regexp_replace(text, '"[^"]*"', "")
        return {s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) + 1 for s in SEPARATORS}

    top = lines.sparkSession.range(1).select(*[c.alias(s) for s, c in fields(F.lit(header)).items()]).first()
    split = [s for s in SEPARATORS if top[s] > 1]
    if len(split) < 2:
        return split[0] if split else SEPARATORS[0]
    here = fields(F.col("value"))
    hits = lines.agg(*[F.count_if(here[s] == top[s]).alias(s) for s in split]).first()
    return max(split, key=lambda s: (hits[s], top[s], -SEPARATORS.index(s)))


def _open_lines(sep: str) -> Column:
    """How many lines (``value``) do not end outside of quotes."""
    line = F.col("value")
    return F.count_if(line.contains('"') & ~line.rlike(spanning.Quoted(sep).complete_line))


def _layout(spark: SparkSession, path: str, sep: str | None, encoding: str | None) -> tuple[str, str, str, bool]:
    """Encoding, header line, separator, and whether every line ends outside of quotes.

    Lines are read as UTF-8 first. Where the header leaves one separator, one aggregate over all of them tells both whether that encoding was
    right and the rest.
    """
    guessed = encoding or "UTF-8"
    lines = _lines(spark, path, guessed)
    first = lines.first()
    header = (first[0] or "") if first else ""
    bare = re.sub('"[^"]*"', "", header)
    present = [sep] if sep else [s for s in SEPARATORS if s in bare]
    only = present[0] if len(present) == 1 else SEPARATORS[0] if not present else None
    odd = F.lit(0).cast("long") if encoding else F.count_if(~F.is_valid_utf8("value"))
    facts = lines.agg(odd, _open_lines(only) if only else F.lit(0).cast("long")).first()
    if facts[0]:
        return _layout(spark, path, sep, FALLBACK_ENCODING)
    if only:
        return guessed, header, only, not facts[1]
    sep = guess_separator(lines, header.rstrip("\r"))
    return guessed, header, sep, not lines.agg(_open_lines(sep)).first()[0]


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    infer: bool = True,
    null_mark: str | None = None,
) -> DataFrame:
    """Header line, quoted fields, leading blanks dropped, too long lines skipped.

    An extra last field catches overlong lines, which are skipped; short lines are filled with nulls. Text columns whose
    every value is a number (thousands commas allowed) become numbers. Separator and encoding are found by a scan of the lines
    where they are not given. Files are read in ranges by many tasks, whatever their fields hold: where every line ends outside of
    quotes, by Spark's reader, else by :mod:`prismtally.sources.spanning`.
    """
    encoding, header, sep, closed = _layout(spark, path, sep, encoding)
    windows = header.endswith("\r")
    options = {**csv_options(null_mark), "encoding": encoding, "ignoreLeadingWhiteSpace": "true", "sep": sep}
    del options["lineSep"]  # the reader then takes both kinds of line ends
    names = [n.strip() for n in spark.read.options(header="true", **options).csv(path).columns]
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(names))])
    schema = schema.add(OVERFLOW, T.StringType())
    if closed:
        ends = {} if windows else {"lineSep": "\n"}
        rows = spark.read.options(header="true", mode="PERMISSIVE", **options, **ends).schema(schema).csv(path)
    else:
        text = F.decode("record", encoding)
        text = F.regexp_replace(text, "\r$", "") if windows else text
        whole = spanning.Quoted(sep)
        parsed = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), {**options, "mode": "PERMISSIVE", "multiLine": "true"})
        rows = spanning.records(spark, path, whole).select(parsed.alias("r")).select("r.*")
    kept = rows.where(col(OVERFLOW).isNull()).drop(OVERFLOW).toDF(*names)
    return infer_text_types(kept) if infer else kept


def read_json(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """One document (list of records or a single object) per file, or line-delimited if every line is an object.

    Lists of records are cut into records range by range (:mod:`prismtally.sources.spanning`), written as lines and read again, so
    one large file is many tasks; a file that is a single object is one record and one task.
    """
    encoding = encoding or text_encoding(spark, path)
    line = F.trim(F.regexp_replace("value", r"\s+$", ""))
    other = _lines(spark, path, encoding).where((line != "") & ~(line.startswith("{") & line.endswith("}")))
    reader = spark.read.option("encoding", encoding)
    if other.isEmpty():
        return flatten_structs(reader.json(path))
    cutter = spanning.Listed()
    ranges = spanning.effects(spanning.pieces_of(spark, path, cutter.separator), cutter)
    if ranges.openings != {b"["}:
        return flatten_structs(reader.option("multiLine", True).json(path))
    lines = scratch_path(spark, "records")
    # Line breaks outside of strings are blanks; inside they cannot stand as they are.
    one_line = F.translate(F.decode("record", encoding), "\r\n", "  ")
    spanning.records(spark, path, cutter, ranges).select(one_line.alias("value")).write.text(lines)
    return flatten_structs(spark.read.json(lines))


def _leaves(schema: T.StructType, reference: Column | None, prefix: str, sep: str) -> list[tuple[str, Column]]:
    out = []
    for f in schema.fields:
        here = col(f.name) if reference is None else reference.getField(f.name)
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, here, name + sep, sep)
        else:
            out.append((name, here))
    return out


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested objects become columns named by their path; lists stay as they are. A projection only."""
    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    return df.select(*[c.alias(n) for n, c in _leaves(df.schema, None, "", sep)])


def flatten_deep(df: DataFrame, sep: str = "_") -> DataFrame:
    """Objects joined by ``_`` and lists of objects spread to ``name_i_field`` columns.

    The width of each list of objects is measured (one aggregate per nesting level); lists of
    plain values stay lists. The columns follow the longest list, so for long lists the long form of
    :func:`explode_records` is the better one.
    """
    while True:
        df = flatten_structs(df, sep)
        nested = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        ]
        if not nested:
            return df
        widths = df.agg(*[F.max(F.size(col(n))).alias(f"w{i}") for i, n in enumerate(nested)]).first()
        out: list[Column] = []
        for name in df.columns:
            if name not in nested:
                out.append(col(name))
                continue
            width = max(widths[nested.index(name)] or 0, 0)
            # ``get`` is null past the end of a shorter list; the struct itself is split next round.
            out += [F.get(col(name), F.lit(i)).alias(f"{name}{sep}{i}") for i in range(width)]
        df = df.select(*out)


def explode_records(df: DataFrame, column: str, sep: str = "_") -> DataFrame:
    """The long form of a list of objects: one row per element with its position."""
    others = [col(c) for c in df.columns if c != column]
    exploded = df.select(*others, F.posexplode(col(column)).alias(f"{column}{sep}index", column))
    return flatten_structs(exploded, sep)


def _json_object(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))


def json_schema(df: DataFrame, column: str) -> T.StructType | None:
    """The type of the objects in a JSON text column, merged over all rows by one aggregate; ``None`` if it holds no objects.

    A field that holds values of several types stays a variant. Texts that are no JSON objects do not count.
    """
    found = df.select(_json_object(col(column)).alias("v")).agg(F.schema_of_variant_agg("v")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return None
    return T.StructType.fromDDL("root " + re.sub(r"\bOBJECT<", "STRUCT<", found).replace("STRUCT<>", "STRING")).fields[0].dataType


def flatten_json_text(df: DataFrame, column: str, schema: str | T.StructType | None = None, sep: str = "_") -> DataFrame:
    """S8 for a text column that holds JSON: parsed, then flattened next to the rest.

    Without ``schema`` the texts tell theirs: they are parsed once into variants, whose merged type is read ahead. A field of mixed types
    becomes text in JSON form; a text that is no JSON object gives nulls.
    """
    if schema is not None:
        return flatten_deep(df.withColumn(column, F.from_json(col(column), schema)), sep)
    found = json_schema(df, column)
    if found is None:
        return df
    parsed = F.try_variant_get(_json_object(col(column)), "$", found.simpleString())
    flat = flatten_deep(df.withColumn(column, parsed), sep)
    mixed = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.VariantType)]
    return flat.withColumns({c: F.coalesce(F.try_variant_get(col(c), "$", "string"), F.to_json(col(c))) for c in mixed}) if mixed else flat


def explode_json(df: DataFrame, column: str, path: str = "$", sep: str = "_") -> DataFrame:
    """The long form of a JSON text column: a row per element of the list, or field of the object, at ``path``.

    ``{column}{sep}index``, ``{column}{sep}key`` (of a field) and ``{column}{sep}value`` (scalars as text, the rest as JSON) stand beside the other
    columns, whatever the elements hold and however many there are. Rows without elements are left out.
    """
    at = F.try_variant_get(F.try_parse_json(col(column)), path, "variant")
    rows = df.withColumn(column, at).where(col(column).isNotNull())
    spread = rows.lateralJoin(df.sparkSession.tvf.variant_explode(col(column).outer()))
    text = F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))
    others = [col(c) for c in df.columns if c != column]
    return spread.select(*others, F.col("pos").alias(f"{column}{sep}index"), F.col("key").alias(f"{column}{sep}key"), text.alias(f"{column}{sep}value"))
