"""Row filters, row policies and exact sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import as_text, col, field_type, moment

ANY_VALUE = (None, "", "__all__")
INLINE_POLICY_VALUES = 10_000


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"The dataset has no column {', '.join(missing)}")
    return df.select(*[col(c) for c in columns])


def text_in(df: DataFrame, column: str, values: list[str]) -> Column:
    """``str(column) IN values`` written so that it can reach the file scan where possible.

    Comparing the text of a whole-number column blocks push-down, so the values are parsed
    instead; a value that is not the canonical text of such a number can never match.
    """
    dtype = field_type(df, column)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(dtype)]
        numbers = []
        for v in values:
            try:
                parsed = int(v)
            except ValueError:
                continue
            if str(parsed) == v and -(2**bits) <= parsed < 2**bits:
                numbers.append(parsed)
        return col(column).isin(numbers) if numbers else F.lit(False)
    return as_text(df, column).isin([str(v) for v in values])


def filter_equals(df: DataFrame, column: str | None, value) -> DataFrame:
    """Equality by text; no-op for an empty choice or an unknown column. Null never matches."""
    if not column or column not in df.columns or value in ANY_VALUE:
        return df
    return df.where(text_in(df, column, [str(value)]))


def filter_dates(df: DataFrame, column: str | None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range, either bound optional; unparsable dates drop out."""
    if not column or column not in df.columns:
        return df
    if start:
        df = df.where(not_before(df, column, start))
    if end:
        df = df.where(not_after(df, column, end))
    return df


def not_before(df: DataFrame, column: str, start: str) -> Column:
    """``column >= start`` as a comparison of the bare column, which reaches the file scan."""
    dtype, bound = field_type(df, column), _full(start)
    if isinstance(dtype, T.TimestampType):
        return col(column) >= F.to_timestamp(F.lit(bound))
    if isinstance(dtype, T.DateType):
        midnight = bound.endswith(" 00:00:00")
        return col(column) >= F.to_date(F.lit(bound)) if midnight else col(column) > F.to_date(F.lit(bound))
    return moment(df, column) >= F.to_timestamp_ntz(F.lit(bound))


def not_after(df: DataFrame, column: str, end: str) -> Column:
    dtype, bound = field_type(df, column), _full(end)
    if isinstance(dtype, T.TimestampType):
        return col(column) <= F.to_timestamp(F.lit(bound))
    if isinstance(dtype, T.DateType):
        return col(column) <= F.to_date(F.lit(bound))
    return moment(df, column) <= F.to_timestamp_ntz(F.lit(bound))


def _full(bound: str) -> str:
    text = str(bound).strip().replace("T", " ")
    return text if " " in text else text + " 00:00:00"


def apply_chart_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    filters = filters or {}
    df = filter_equals(df, filters.get("column"), filters.get("value"))
    return filter_dates(df, filters.get("date_column"), filters.get("start_date"), filters.get("end_date"))


@dataclass(frozen=True)
class RowPolicy:
    """The values of one column that a user may see; no values restrict nothing."""

    user: str
    column: str
    allowed_values: tuple[str, ...]

    @classmethod
    def parse(cls, entry: object) -> RowPolicy | None:
        """A policy from its stored form, or None where that names no user or no column."""
        if not isinstance(entry, dict):
            return None
        names = [str(entry.get(field) or "").strip() for field in ("user", "column")]
        return cls(*names, tuple(map(str, (v for v in entry.get("allowed_values") or () if v is not None)))) if all(names) else None


def clean_policies(raw: list[dict] | None) -> list[RowPolicy]:
    return [policy for policy in map(RowPolicy.parse, raw or ()) if policy]


def apply_row_policies(df: DataFrame, policies: list[RowPolicy], user: str, owner: str | None = None) -> DataFrame:
    """The owner sees everything, others the rows all their policies allow.

    An empty list of values or an unknown column restricts nothing.
    """
    if not user or user == owner:
        return df
    for policy in policies:
        if policy.user != user or not policy.allowed_values or policy.column not in df.columns:
            continue
        values = sorted(set(policy.allowed_values))
        if len(values) <= INLINE_POLICY_VALUES:
            df = df.where(text_in(df, policy.column, values))
        else:
            allowed = df.sparkSession.createDataFrame([(v,) for v in values], "_allowed string")
            df = df.join(allowed, as_text(df, policy.column) == F.col("_allowed"), "left_semi")
    return df


def apply_policy_table(df: DataFrame, policy_table: DataFrame, user: str, columns: list[str]) -> DataFrame:
    """P8 for policies kept as a table (user, column, value), which may be long.

    Each restricted column is one left-semi join; a hot value on the data side cannot multiply
    rows and its partition is split by AQE. Columns without an entry restrict nothing.
    """
    mine = policy_table.where(F.col("user") == user)
    restricted = {r[0] for r in mine.where(F.col("column").isin(columns)).select("column").distinct().collect()}
    for c in columns:
        if c in restricted and c in df.columns:
            allowed = mine.where(F.col("column") == c).select(F.col("value").alias("_allowed"))
            df = df.join(allowed, as_text(df, c) == F.col("_allowed"), "left_semi")
    return df


HASH_DIGITS, STEP_DIGITS, TAKE_AT_MOST = 15, 3, 10_000


def sample_exact(df: DataFrame, percentage: float, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``max(1, int(rows * percentage / 100))`` rows, the same ones on every run.

    Rows are ranked by the first 15 hexadecimal digits of the MD5 of seed and identity; digits of one width sort as text like the numbers
    they write, so they are never converted. The hash at the wanted rank is found by counting prefixes, three further digits per pass (at most
    4,096 counters, map-side combined), until the prefix at the cut holds a handful of rows; the sample itself is then one filter. Nothing
    is sorted or shuffled but counters. With ``key`` (columns that identify a row) the choice does not depend on the file layout.
    """
    if percentage >= 100:
        return df
    identity = [col(c) for c in key] if key else [F.col("_row")]
    ranked = df if key else df.select("*", F.monotonically_increasing_id().alias("_row"))
    written = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    ranked = ranked.withColumn("_h", F.substring(F.md5(written), 1, HASH_DIGITS))

    at_cut, below, wanted, width, prefix = ranked, 0, None, 0, ""
    while True:
        width += STEP_DIGITS
        counts = sorted(at_cut.groupBy(F.substring("_h", 1, width).alias("b")).count().collect())
        if wanted is None:
            total = sum(r["count"] for r in counts)
            wanted = max(1, int(total * percentage / 100))
            if total <= wanted:
                return df
        for prefix, held in counts:
            if below + held >= wanted:
                break
            below += held
        at_cut = ranked.where(F.col("_h").startswith(prefix))
        if held <= TAKE_AT_MOST or width == HASH_DIGITS:
            break
    missing = wanted - below
    at_prefix = F.col("_h").startswith(prefix)
    if width == HASH_DIGITS or missing == held:
        edge, tied = F.lit(False) if missing < held else at_prefix, missing < held
    else:
        hashes = [r["_h"] for r in at_cut.select("_h").orderBy("_h").limit(missing + 1).collect()]
        edge, tied = at_prefix & (F.col("_h") <= F.lit(hashes[missing - 1])), hashes[missing] == hashes[missing - 1]
    lower = F.col("_h") < F.lit(prefix)
    names = [col(c) for c in df.columns]
    if not tied:
        return ranked.where(lower | edge).select(*names)
    # Equal hashes of distinct rows at the cut: the rest is taken in the order of the identity.
    rest = at_cut.orderBy("_h", *identity).limit(missing)
    return ranked.where(lower).unionByName(rest).select(*names)
