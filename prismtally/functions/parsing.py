"""Tolerant parsing of text into numbers and timestamps (never raises under ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text. A plain cast would also accept Java suffixes such as "1d".
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
WHOLE_PATTERN = r"^\s*[+-]?\d{1,18}\s*$"

# White space as text stripping understands it, Unicode blanks included.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
    "       　"
)

# Date layouts read from text besides ISO forms: the shape that selects a layout, and the layout.
_MONTH = r"[A-Za-z]{3,9}"
DATE_LAYOUTS = (
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}", "M/d/yyyy H:mm"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (rf"\d{{1,2}} {_MONTH} \d{{4}}", "d MMM yyyy"),
    (rf"\d{{1,2}} {_MONTH} \d{{4}}", "d MMMM yyyy"),
    (rf"{_MONTH} \d{{1,2}}, \d{{4}}", "MMM d, yyyy"),
    (rf"{_MONTH} \d{{1,2}}, \d{{4}}", "MMMM d, yyyy"),
    (r"(19|20)\d{6}", "yyyyMMdd"),
)
DATE_PATTERN = "^(" + "|".join(dict.fromkeys(shape for shape, _ in DATE_LAYOUTS)) + ")$"


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def parse_number(c: Column, strip_commas: bool = False) -> Column:
    if strip_commas:
        c = without_commas(c)
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def parse_whole(c: Column, strip_commas: bool = False) -> Column:
    if strip_commas:
        c = without_commas(c)
    return F.when(c.rlike(WHOLE_PATTERN), F.trim(c).try_cast("long"))


def parse_datetime(c: Column) -> Column:
    """ISO forms by cast (which fails cheaply), other layouts only on texts of their shape, because
    a failing layout is far dearer than a pattern. Zone offsets are converted to UTC."""
    text = F.trim(c)
    zoned = text.contains(":") & (text.endswith("Z") | F.substring(text, -6, 6).rlike(r"[+-]\d{2}:?\d{2}$"))
    local = text.try_cast("timestamp").cast("timestamp_ntz")
    iso = F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)).otherwise(
        text.try_cast("timestamp_ntz")
    )
    others = [
        F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz"))
        for shape, layout in DATE_LAYOUTS
    ]
    # No layout goes without a digit, which spares plain words every cast.
    return F.when(text.rlike(r"\d"), F.coalesce(iso, F.when(text.rlike(DATE_PATTERN), F.coalesce(*others))))


def strip(c: Column) -> Column:
    """Trim both ends of every kind of white space, tabs, newlines and Unicode blanks included."""
    return F.btrim(c, F.lit(BLANKS))
