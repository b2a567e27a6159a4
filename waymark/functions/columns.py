"""Formatting, escaping and keys as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import WHITE

_TRIM = rf"^[{WHITE}]+|[{WHITE}]+$"
LABELS = {"lat": "Latitude", "lon": "Longitude"}


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _TRIM, "")


def one_word(c: Column) -> Column:
    """The first word of a text, '' if it has none."""
    return F.coalesce(F.regexp_extract(c, rf"[^{WHITE}]+", 0), F.lit(""))


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with the value computed once, however often it is used; nested uses would else multiply."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def to_fixed(c: Column, digits: int) -> Column:
    """The exact value with ``digits`` decimals, ties away from zero."""

    def fixed(x: Column) -> Column:
        doubled = x * (1 << (digits + 1))
        odd = (doubled == F.floor(doubled)) & (F.abs(doubled) < 2**53) & (F.pmod(doubled.cast("long"), F.lit(2)) == 1)
        return F.format_number(F.when(odd, x + F.signum(x) * (10.0 ** -(digits + 1))).otherwise(x), digits)

    return F.replace(let(c.cast("double") + F.lit(0.0), fixed), F.lit(","), F.lit(""))


def format_dd(c: Column) -> Column:
    """Decimal degrees: six decimals without trailing zeros, one decimal at least; '' for null."""
    text = F.regexp_replace(F.regexp_replace(to_fixed(c, 6), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    return F.when(c.isNull() | F.isnan(c), "").otherwise(text)


def format_dms(c: Column, axis: str) -> Column:
    """Degrees, minutes and seconds of two decimals, with the hemisphere's letter; '' for null."""
    pad = lambda s: F.lpad(s, F.greatest(F.length(s), F.lit(2)), F.lit("0"))

    def parts(size: Column) -> Column:
        minutes = (size - F.floor(size)) * 60
        return F.struct(F.floor(size).alias("d"), F.floor(minutes).alias("m"), ((minutes - F.floor(minutes)) * 60).alias("s"))

    def carried(p: Column) -> Column:
        """Seconds that round to 60 are a minute more, and 60 minutes a degree more."""
        over = to_fixed(p["s"], 2).cast("double") >= 60
        m = p["m"] + over.cast("int")
        return F.struct((p["d"] + (m >= 60).cast("int")).alias("d"), F.when(m >= 60, 0).otherwise(m).alias("m"), to_fixed(F.when(over, 0.0).otherwise(p["s"]), 2).alias("s"))

    def written(p: Column) -> Column:
        seconds = F.regexp_replace(F.regexp_replace(p["s"], r"\.00$", ""), r"(\.\d)0$", "$1")
        return F.concat(p["d"].cast("string"), F.lit("°"), pad(p["m"].cast("string")), F.lit("'"), let(seconds, pad), F.lit('"'))

    hemi = F.when(c < 0, "W" if axis == "lon" else "S").otherwise("E" if axis == "lon" else "N")
    made = F.concat(let(let(let(F.abs(c), parts), carried), written), hemi)
    return F.when(c.isNull() | F.isnan(c), "").otherwise(made)


def coord_columns(fmt: str) -> list[tuple[str, str, str]]:
    """(field, mode, label) of the coordinate columns of a format: dd, dms or both."""
    modes = {"dms": ["dms"], "both": ["dd", "dms"]}.get(fmt, ["dd"])
    return [(field, mode, f"{LABELS[field]} ({mode.upper()})") for mode in modes for field in ("lat", "lon")]


def cell_text(field: str, mode: str, fmt: str) -> Column:
    """Text of a coordinate cell of rows (lat, lon, lat_raw, lon_raw): the typed text where it was not understood."""
    value, raw = F.col(field), F.col(f"{field}_raw")
    shown = format_dms(value, field) if mode == "dms" else format_dd(value)
    return F.when(raw.isNotNull(), F.lit("") if mode == "dms" and fmt == "both" else raw).otherwise(shown)


def csv_escape(c: Column) -> Column:
    """A CSV field: quoted only where it holds a comma, quote or line end."""
    s = F.coalesce(c, F.lit(""))
    return F.when(F.regexp_like(s, F.lit('[",\n\r]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def coord_part(value: Column, raw: Column) -> Column:
    """Half of a row's coordinate key: the value at six decimals, else the typed text, else ''."""
    number = F.concat(F.lit("n:"), to_fixed(value, 6))
    tiny = (value < 0) & (to_fixed(value, 6) == "0.000000")
    number = F.when(tiny, "n:-0.000000").otherwise(number)
    text = trim(F.coalesce(raw, F.lit("")))
    return F.when(value.isNotNull() & ~F.isnan(value), number).when(text != "", F.concat(F.lit("r:"), text)).otherwise("")


def has_coordinate() -> Column:
    """Whether a row has a value or typed text in either half."""
    return (coord_part(F.col("lat"), F.col("lat_raw")) != "") | (coord_part(F.col("lon"), F.col("lon_raw")) != "")


def cell(i: int) -> Column:
    """Cell ``i`` (from 0) of a row, '' where it is missing."""
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def padded_cells(n: int) -> Column:
    """The cells, filled up with '' or cut to ``n``."""
    return F.slice(F.concat(F.coalesce("cells", F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), 1, n)


LOC_KEY = ["file_id", "page_num", "half", "start"]
