"""Load-time preparation (P1-P4): names, empty columns and rows, text-to-type coercion.

All columns of a step are judged by one aggregate job; its result is one row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import col, field_type, present
from prismtally.functions.parsing import parse_datetime, parse_number, parse_whole, without_commas

COERCION_SHARE = 0.8
TYPING_ROWS = 1000  # rows that rule types out before all rows are tested


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that counts, averages and joins see one kind of missing value."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.select(*[present(df, c).alias(c) if c in floats else col(c) for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep the columns that hold at least one value."""
    filled = df.agg(*[F.max(present(df, c).isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if filled[i]])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    filled = [present(df, c).isNotNull() for c in df.columns]
    return df.where(reduce(or_, filled)) if filled else df


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def parse_ratio(df: DataFrame, tests: dict[str, Column], denominators: dict[str, Column] | None = None) -> dict[str, float]:
    """Share of values each test parses, all tests in one aggregate job.

    The denominator is the row count unless a column is given whose non-null values count.
    """
    if not tests:
        return {}
    denominators = denominators or {}
    aggs = []
    for i, (name, parsed) in enumerate(tests.items()):
        base = F.count(denominators[name]) if name in denominators else F.count(F.lit(1))
        aggs.append(F.try_divide(F.count(parsed).cast("double"), base.cast("double")).alias(f"r{i}"))
    row = df.agg(*aggs).first()
    return {name: row[i] if row[i] is not None else 0.0 for i, name in enumerate(tests)}


def _typing_shares(df: DataFrame, wanted: list[str], strip_commas: bool, number_share_of: str, threshold: float, also: dict[str, Column] | None = None) -> dict[str, float]:
    """Shares of numbers and whole numbers of all columns, then of dates for the columns that are no numbers.

    Date parsing is by far the dearer test, so the second scan reads only the columns that need it.
    """
    tests: dict[str, Column] = dict(also or {})
    denominators: dict[str, Column] = {}
    for c in wanted:
        tests[f"number:{c}"] = parse_number(col(c), strip_commas)
        tests[f"whole:{c}"] = parse_whole(col(c), strip_commas)
        denominators[f"whole:{c}"] = col(c)
        if number_share_of == "non_null":
            denominators[f"number:{c}"] = col(c)
    shares = parse_ratio(df, tests, denominators)
    rest = [c for c in wanted if shares[f"number:{c}"] < threshold]
    return {**shares, **parse_ratio(df, {f"date:{c}": parse_datetime(col(c)) for c in rest})}


def _typed(name: str, shares: dict[str, float], strip_commas: bool, threshold: float) -> Column:
    if shares[f"number:{name}"] >= threshold:
        # Whole numbers stay whole, so that keys keep their text form.
        whole = shares[f"whole:{name}"] == 1.0
        return (parse_whole if whole else parse_number)(col(name), strip_commas).alias(name)
    if shares[f"date:{name}"] >= threshold:
        return parse_datetime(col(name)).alias(name)
    return col(name)


def coerce_text(
    df: DataFrame,
    columns: list[str] | None = None,
    strip_commas: bool = True,
    number_share_of: str = "non_null",
    threshold: float = COERCION_SHARE,
) -> DataFrame:
    """Cast text columns that are numbers, else dates, in at least ``threshold`` of the cases.

    Numbers are measured against non-null values (P2) or all rows (P4), dates always against
    all rows (P3). Values that do not parse become null.
    """
    wanted = [c for c in (columns or df.columns) if isinstance(field_type(df, c), T.StringType)]
    shares = _typing_shares(df, wanted, strip_commas, number_share_of, threshold)
    return df.select(*[_typed(c, shares, strip_commas, threshold) if c in wanted else col(c) for c in df.columns])


def infer_text_types(df: DataFrame) -> DataFrame:
    """Reader inference: a text column becomes a number or boolean only if every value is one.

    The first rows rule out what a column cannot be; one scan of all rows tests what is left. Where every value has passed, casts need
    no pattern in front of them any more.
    """
    wanted = text_columns(df)

    tests: dict[str, Column] = {}
    for c in wanted:
        whole = parse_whole(col(c), True)
        tests[f"whole:{c}"] = whole
        # Every whole number is a number, so the dearer pattern is for the others.
        tests[f"number:{c}"] = F.when(whole.isNotNull(), 1.0).otherwise(parse_number(col(c), True))
        tests[f"flag:{c}"] = F.when(F.lower(col(c)).isin("true", "false"), 1)
    tested = {t: col(t.split(":", 1)[1]) for t in tests}
    early = parse_ratio(df.limit(TYPING_ROWS), {**tests, **{f"seen:{c}": col(c) for c in wanted}}, tested)
    # A column without a value in the first rows may still be anything.
    left = {t: test for t, test in tests.items() if early[t] == 1.0 or early[f"seen:{t.split(':', 1)[1]}"] == 0.0}
    left |= {f"number:{c}": parse_number(col(c), True) for c in wanted if f"number:{c}" in left and f"whole:{c}" not in left}
    shares = {t: 0.0 for t in tests} | parse_ratio(df, left, tested)
    out = []
    for c in df.columns:
        if c not in wanted:
            out.append(col(c))
        elif shares[f"whole:{c}"] == 1.0:
            out.append(F.trim(without_commas(col(c))).try_cast("long").alias(c))
        elif shares[f"number:{c}"] == 1.0:
            out.append(F.trim(without_commas(col(c))).try_cast("double").alias(c))
        elif shares[f"flag:{c}"] == 1.0:
            out.append(F.lower(col(c)).try_cast("boolean").alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def prepare(df: DataFrame) -> DataFrame:
    """Stripped names, no empty columns or rows, typed text columns.

    One scan tells which columns hold values at all and which texts are numbers, a second one which of the
    other texts are dates. Rows without any value do not count, whichever columns are dropped later.
    """
    rows = drop_empty_rows(normalise_missing(strip_column_names(df)))
    wanted = text_columns(rows)
    filled = {f"filled:{c}": col(c) for c in rows.columns}
    shares = _typing_shares(rows, wanted, True, "non_null", COERCION_SHARE, filled)
    return rows.select(
        *[
            _typed(c, shares, True, COERCION_SHARE) if c in wanted else col(c)
            for c in rows.columns
            if shares[f"filled:{c}"] > 0
        ]
    )


def prepare_chart_subset(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of one chart; commas are not stripped and all rows count."""
    subset = drop_empty_rows(normalise_missing(df.select(*[col(c) for c in columns])))
    return drop_empty_rows(coerce_text(subset, strip_commas=False, number_share_of="all"))
