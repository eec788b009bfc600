"""Date and number scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import c, number_text

# The built-in number formats that show a date, a time, or both.
DATE_FORMATS = (14, 15, 16, 17, 27, 28, 29, 30, 31, 36, 50, 57)
TIME_FORMATS = (18, 19, 20, 21, 45, 46, 47)
DATETIME_FORMATS = (22,)
# Pixels in a unit of length at 96 to the inch.
PIXELS = {"in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "pt": 96.0 / 72.0, "px": 1.0}
EMU_PER_PIXEL = 9525.0
#: What a decimal or exponent number looks like; inf and nan count as numbers too.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def is_number(x: str | Column) -> Column:
    return F.rlike(c(x), F.lit(NUMBER))


def serial_to_iso(serial: str | Column, kind: str | Column, compat: bool = False) -> Column:
    """A spreadsheet's day number as text; kind is date, time or datetime.

    Days from 60 on come out one day early, as existing results have them; ``compat`` gives the true date.
    """
    s, k = c(serial), c(kind)
    day = F.floor(s)
    seconds = F.least(F.round((s - day) * 86400), F.lit(86399)).cast("int")
    shift = F.lit(0) if compat else F.when(day >= 60, 1).otherwise(0)
    date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), (day - shift).cast("int")), "yyyy-MM-dd")
    two = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
    time = F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))
    out = F.when(k == "date", date).when(k == "time", time).otherwise(F.concat_ws(" ", date, time))
    return F.when((s < 0) | F.isnan(s), number_text(s)).otherwise(out)


def looks_like_serial(x: str | Column) -> Column:
    return c(x).between(10000, 100000)


def format_kind(code_id: str | Column, code: str | Column) -> Column:
    """date, time, datetime or null for a number format."""
    i = c(code_id)
    bare = F.lower(F.regexp_replace(c(code), r'\\.|"[^"]*"|\[[^\]]*\]', ""))
    date = F.contains(bare, F.lit("y")) | F.contains(bare, F.lit("d"))
    time = F.contains(bare, F.lit("h")) | F.contains(bare, F.lit("s")) | F.contains(bare, F.lit("am/pm"))
    return (
        F.when(i.isin(*DATE_FORMATS), "date").when(i.isin(*TIME_FORMATS), "time").when(i.isin(*DATETIME_FORMATS), "datetime")
        .when(date & time, "datetime").when(date, "date").when(time, "time")
    )


def header_kind(name: str | Column) -> Column:
    """The kind that a column's header promises."""
    n = F.lower(c(name))
    has = lambda s: F.contains(n, F.lit(s))
    return F.when(has("timestamp") | has("datetime") | has("time") | has("when"), "datetime").when(has("date"), "date")


def length_to_pixels(x: str | Column) -> Column:
    number = F.regexp_extract(c(x), r"^\s*(-?[0-9]*\.?[0-9]+)", 1)
    unit = F.lower(F.regexp_extract(c(x), r"([A-Za-z]+)\s*$", 1))
    factor = F.lit(None).cast("double")
    for name, px in PIXELS.items():
        factor = F.when(unit == name, px).otherwise(factor)
    return F.when(number != "", number.try_cast("double") * factor)


def emu_to_pixels(x: str | Column) -> Column:
    return c(x).cast("double") / EMU_PER_PIXEL
