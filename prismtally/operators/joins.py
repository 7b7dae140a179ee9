"""Equi-joins on normalised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import as_text, col, field_type, kind_of, moment, number
from prismtally.functions.parsing import parse_datetime, parse_number, strip

JOIN_TYPES = ("left", "inner", "outer")
KEY_SHARE = 0.9
CLASH_SUFFIX = "_related"


def key_kind(df: DataFrame, column: str) -> str:
    """How a key column is compared: 'whole', 'number', 'datetime', 'text' or 'empty'.

    Typed columns need no job. Text needs one aggregate: at least 90 % of the non-null values
    must parse as numbers, else as dates.
    """
    dtype = field_type(df, column)
    if isinstance(dtype, T.IntegralType):
        return "whole"
    kind = kind_of(dtype)
    if kind == "numeric":
        return "number"
    if kind != "text":
        return kind if kind == "datetime" else "text"
    if not isinstance(dtype, T.StringType):
        return "text"
    c = strip(col(column))
    seen, numbers, dates = df.agg(F.count(c), F.count(parse_number(c)), F.count(parse_datetime(c))).first()
    if seen == 0:
        return "empty"
    if numbers >= KEY_SHARE * seen:
        return "number"
    return "datetime" if dates >= KEY_SHARE * seen else "text"


def normalised_key(df: DataFrame, column: str, kind: str) -> Column:
    """The key as a number, a time or stripped text; null only where the cell is missing.

    A text among numbers or times that does not parse compares by its text, after a letter no parsed key begins with.
    """
    if kind == "whole":
        return col(column).cast("long")
    text = strip(as_text(df, column))
    if kind not in ("number", "datetime"):
        return text
    textual = isinstance(field_type(df, column), T.StringType)
    if kind == "number":
        # Adding zero makes one key of 0.0 and -0.0.
        parsed = parse_number(text) + F.lit(0.0) if textual else number(df, column) + F.lit(0.0)
    else:
        parsed = moment(df, column)
    return F.coalesce(F.concat(F.lit("="), parsed.cast("string")), F.concat(F.lit("t"), text))


def common_kind(left: str, right: str) -> str:
    """Sides that normalise differently are both compared as stripped text."""
    if left == right:
        return left
    pair = {left, right}
    if "empty" in pair:
        return (pair - {"empty"}).pop()
    if pair == {"whole", "number"}:
        return "number"
    return "text"


def check_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> None:
    """All that is wrong with the arguments of a join, in one message."""
    wrong = [f"{side} side has no column {key!r}" for side, df, key in (("left", left, left_key), ("right", right, right_key)) if key not in df.columns]
    if how not in JOIN_TYPES:
        wrong.append(f"{how!r} is none of {', '.join(JOIN_TYPES)}")
    if wrong:
        raise ValueError(f"Cannot join: {'; '.join(wrong)}.")


def join_on_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Both key columns stay; clashing names on the right get a suffix.

    A missing key matches nothing: such rows of the left side stay with an empty right side (none in an inner
    join), those of the right side appear in an outer join only. So the output grows with the matches of real keys. Written as
    an equi-join, Catalyst picks broadcast or sort-merge by size and AQE splits hot keys. A full outer join cannot be split that
    way and is therefore put together from a left join and the unmatched right rows.
    """
    check_join(left, right, left_key, right_key, how)
    kind = common_kind(key_kind(left, left_key), key_kind(right, right_key))
    renamed = [c + CLASH_SUFFIX if c in left.columns else c for c in right.columns]
    l_side = left.withColumn("__lk", normalised_key(left, left_key, kind))
    r_side = right.withColumn("__rk", normalised_key(right, right_key, kind)).toDF(*renamed, "__rk")
    same = F.col("__lk") == F.col("__rk")
    joined = l_side.join(r_side, same, "inner" if how == "inner" else "left").drop("__lk", "__rk")
    if how != "outer":
        return joined
    known = l_side.select("__lk").where("__lk IS NOT NULL").distinct()
    unmatched = r_side.join(known, same, "left_anti").drop("__rk")
    return joined.unionByName(unmatched, allowMissingColumns=True)
