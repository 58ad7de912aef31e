"""Coordinate Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col_, is_float_text, staged, strip_ws, to_ascii_space



def dms_layers(src, out: str):
    """J2: 'D:M:S X' -> signed degrees rounded to 6 places, as ``out``.

    Exactly two whitespace-separated tokens and three numeric ':' parts;
    direction S or W is negative, anything else positive. Otherwise
    ``out + '_err'`` = 'Invalid coordinate format: <text>'.
    """
    p = f"_{out}_"

    def c(n):
        return F.col(p + n)

    return [
        {p + "raw": col_(src).cast("string")},
        # Python-only whitespace becomes a space, so Java's \s/\S classes apply
        {p + "s": to_ascii_space(strip_ws(c("raw")))},
        {p + "two": c("s").rlike(r"^\S+\s+\S+$"),
         p + "dir": F.regexp_extract(c("s"), r"(\S+)$", 1),
         p + "parts": F.split(F.regexp_extract(c("s"), r"^(\S+)", 1), ":", -1)},
        {p + "p0": F.get(c("parts"), 0), p + "p1": F.get(c("parts"), 1), p + "p2": F.get(c("parts"), 2)},
        {p + "ok": F.coalesce(c("two") & (F.size(c("parts")) == 3) & is_float_text(c("p0"))
                              & is_float_text(c("p1")) & is_float_text(c("p2")), F.lit(False))},
        {out: F.when(c("ok"), F.round(
            (c("p0").cast("double") + c("p1").cast("double") / 60 + c("p2").cast("double") / 3600)
            * F.when(c("dir").isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0)), 6)),
         out + "_err": F.when(~c("ok"), F.concat(F.lit("Invalid coordinate format: "),
                                                 F.coalesce(c("raw"), F.lit("None"))))},
    ]


def add_dms(df, src, out: str):
    return staged(df, *dms_layers(src, out))


def exif_degrees(value_text, ref) -> Column:
    """J3: 'd m s' (three numbers) + reference -> degrees; N/E positive,
    any other reference negative; missing or malformed -> NULL; no rounding."""
    v = col_(value_text)
    ref = col_(ref)
    parts = F.split(strip_ws(v), f"{WS}+", -1)
    p0, p1, p2 = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    ok = (F.size(parts) == 3) & is_float_text(p0) & is_float_text(p1) & is_float_text(p2)
    deg = p0.cast("double") + p1.cast("double") / 60 + p2.cast("double") / 3600
    present = v.isNotNull() & (v != "") & ref.isNotNull() & (ref != "")
    return F.when(present & ok, F.when(ref.isin("N", "E"), deg).otherwise(-deg))


def wkt_point(lon_text, lat_text) -> Column:
    """``f'POINT({lon} {lat})'`` from the raw texts."""
    return F.concat(F.lit("POINT("), col_(lon_text), F.lit(" "), col_(lat_text), F.lit(")"))


_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_POINT = rf"^POINT ?\(\s*{_NUM}\s+{_NUM}\s*\)$"


def wkt_or_invalid(loc) -> Column:
    """J4 export side: a stored point as WKT, 'Invalid geometry' when it is
    not a readable point, NULL when there is none."""
    loc = col_(loc)
    return F.when(loc.isNull(), F.lit(None).cast("string")).when(loc.rlike(_POINT), loc).otherwise(F.lit("Invalid geometry"))


def coordinates_text(lat, lon) -> Column:
    """J19: '%.6f, %.6f' when both are present, else NULL."""
    lat, lon = col_(lat), col_(lon)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.6f, %.6f", lat, lon))
