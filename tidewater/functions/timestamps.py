"""Date and time Column expressions (J1, J9-J11, J13, J14, J20, AIS times).

All results are TIMESTAMP_NTZ / DATE built from parsed parts, so nothing
depends on the session time zone. Parsers return ``(value, error)`` pairs:
``error`` is NULL when the input is fine or legitimately missing, and holds
the reject reason otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, is_float_text, is_int_text, staged, strip_cell, strip_ws



def _try_to_date(c: Column, fmt: str) -> Column:
    return F.call_function("try_to_date", c, F.lit(fmt))


def zfill2(c) -> Column:
    """Python ``str.zfill(2)`` (pads, never truncates)."""
    c = col_(c)
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def date_dmy(c) -> Column:
    """``strptime(x, '%d-%m-%Y')`` on stripped text; NULL when it fails."""
    s = strip_ws(col_(c))
    return F.when(s.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), _try_to_date(s, "d-M-yyyy"))


def date_ymd(c) -> Column:
    """``strptime(x, '%Y%m%d')`` for eight digits; NULL when it fails."""
    s = strip_ws(col_(c))
    return F.when(s.rlike(r"^[0-9]{8}$"), _try_to_date(s, "yyyyMMdd"))


def python_timestamp_layers(date_c, time_c, out: str):
    """Date text + time-of-day text -> TIMESTAMP_NTZ (rules in SURVEY 2.9).

    Adds ``out`` (the timestamp) and ``out + '_err'`` (reject reason).

    * date: trimmed, cut at the first '.', then ``d-M-yyyy`` if it holds '-',
      ``yyyyMMdd`` if it is eight digits, else 'Invalid date format: <d>'.
    * time: blank, NA or NAN is midnight; UTC/GMT removed; cut at the first
      comma; two parts are minutes:seconds, three are h:m:s, no range checks.
    * whole seconds and microseconds are truncated as Python's ``int()``
      does, and the result is cut to milliseconds.
    """
    p = f"_{out}_"

    def c(n):
        return F.col(p + n)

    return [
        {p + "d0": F.coalesce(strip_cell(col_(date_c).cast("string")), F.lit("")),
         p + "t0": F.upper(F.coalesce(strip_cell(col_(time_c).cast("string")), F.lit("")))},
        {p + "d1": F.split_part(c("d0"), F.lit("."), F.lit(1)),
         p + "t1": strip_ws(F.replace(F.replace(c("t0"), F.lit("UTC"), F.lit("")), F.lit("GMT"), F.lit("")))},
        {p + "t2": F.when(c("t1").contains(","), strip_ws(F.split_part(c("t1"), F.lit(","), F.lit(1)))).otherwise(c("t1")),
         p + "mid": (c("t0") == "") | c("t0").isin("NA", "NAN"),
         p + "day": F.when(c("d1").contains("-"), date_dmy(c("d1")))
                     .when(c("d1").rlike(r"^[0-9]{8}$"), _try_to_date(c("d1"), "yyyyMMdd"))},
        {p + "ps": F.split(c("t2"), ":", -1)},
        {p + "n": F.size(c("ps")), p + "p0": F.get(c("ps"), 0), p + "p1": F.get(c("ps"), 1),
         p + "p2": F.get(c("ps"), 2)},
        {p + "two": (c("n") == 2) & is_int_text(c("p0")) & is_float_text(c("p1")),
         p + "three": (c("n") == 3) & is_int_text(c("p0")) & is_int_text(c("p1")) & is_float_text(c("p2"))},
        {p + "hh": F.when(c("three"), c("p0").try_cast("bigint")).otherwise(F.lit(0).cast("bigint")),
         p + "mi": F.when(c("three"), c("p1").try_cast("bigint")).when(c("two"), c("p0").try_cast("bigint")),
         p + "ss": F.when(c("three"), c("p2").try_cast("double")).when(c("two"), c("p1").try_cast("double"))},
        # bounds keep the arithmetic far from overflow (about a thousand years)
        {p + "tok": c("mid") | ((c("two") | c("three")) & (F.abs(c("hh")) < 10_000_000)
                                & (F.abs(c("mi")) < 1_000_000_000) & (F.abs(c("ss")) < 1e11)),
         p + "secs": c("ss").cast("bigint")},  # truncates toward zero, like int()
        {p + "total": F.when(c("mid"), F.lit(0).cast("bigint")).otherwise(
            c("hh") * 3_600_000_000 + c("mi") * 60_000_000 + c("secs") * 1_000_000
            + ((c("ss") - c("secs")) * F.lit(1_000_000.0)).cast("bigint"))},
        {out: F.when(c("day").isNotNull() & c("tok"), F.timestamp_add(
            "MICROSECOND", c("total") - F.pmod(c("total"), F.lit(1000)), c("day").cast("timestamp_ntz"))),
         out + "_err": F.when(c("day").isNull(), F.concat(F.lit("Invalid date format: "), c("d1")))
                        .when(~c("tok"), F.concat(F.lit("Invalid time format: "), c("t2")))},
    ]


def add_python_timestamp(df, date_c, time_c, out: str):
    return staged(df, *python_timestamp_layers(date_c, time_c, out))


def strict_date_layers(src, kind, out: str):
    """``safe_parse_date``: adds ``out`` (DATE; blank/missing -> NULL)
    and ``out + '_err'`` ('Invalid date format: <text>' for bad text).

    ``kind`` is 'dmy', 'ymd', or a boolean Column choosing yyyyMMdd per row
    (one parse per row when the format depends on which header held it)."""
    p = f"_{out}_"
    raw = col_(src).cast("string")
    s = F.col(p + "s")
    if isinstance(kind, str):
        parsed = date_dmy(s) if kind == "dmy" else date_ymd(s)
    else:
        parsed = F.when(kind, date_ymd(s)).otherwise(date_dmy(s))
    return [
        {p + "s": strip_cell(raw), p + "raw": raw},
        {p + "present": F.coalesce(F.col(p + "s"), F.lit("")) != ""},
        {out: F.when(F.col(p + "present"), parsed)},
        {out + "_err": F.when(F.col(p + "present") & F.col(out).isNull(),
                              F.concat(F.lit("Invalid date format: "), F.col(p + "raw")))},
    ]


def add_strict_date(df, src, kind, out: str):
    return staged(df, *strict_date_layers(src, kind, out))


_HMS = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9]):([0-5]?[0-9])$"


def strict_time_layers(src, out: str):
    """``safe_parse_time(x, '%H:%M:%S')``: adds ``out`` ('HH:mm:ss'
    text) and ``out + '_err'``."""
    p = f"_{out}_"
    raw = col_(src).cast("string")
    s = F.col(p + "s")
    return [
        {p + "s": strip_cell(raw), p + "raw": raw},
        {p + "present": F.coalesce(s, F.lit("")) != "", p + "ok": s.rlike(_HMS), p + "parts": F.split(s, ":", -1)},
        {out: F.when(F.col(p + "present") & F.col(p + "ok"), F.concat_ws(
            ":", *[F.lpad(F.get(F.col(p + "parts"), i), 2, "0") for i in range(3)])),
         out + "_err": F.when(F.col(p + "present") & ~F.col(p + "ok"),
                              F.concat(F.lit("Invalid time format: "), F.col(p + "raw")))},
    ]


def add_strict_time(df, src, out: str):
    return staged(df, *strict_time_layers(src, out))


def day_first_date(c) -> Column:
    """Pandas ``to_datetime(dayfirst=True, errors='coerce')`` for the
    common shapes d-M-yyyy, d/M/yyyy and yyyy-MM-dd; anything else NULL."""
    s = strip_ws(col_(c))
    return F.coalesce(
        F.when(s.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), _try_to_date(s, "d-M-yyyy")),
        F.when(s.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), _try_to_date(s, "d/M/yyyy")),
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), _try_to_date(s, "yyyy-M-d")),
    )


_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$"
_ZONE = r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$"


def iso_timestamp_layers(src, out: str):
    """ISO-8601 text ('T' or space; seconds and their fraction, and a zone,
    may be there) -> TIMESTAMP_NTZ ``out`` in UTC, NULL when it is not such a
    text or not a real date/time. Text without a zone is UTC already."""
    p = f"_{out}_"
    parts, zone = F.col(p + "parts"), F.col(p + "zone")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))
    # the date's signs are before the time, so only a sign after it is a zone's
    time = F.regexp_replace(F.col(p + "s"), _ZONE, "")
    return [
        {p + "s": strip_ws(col_(src))},
        {p + "ok": F.col(p + "s").rlike(_ISO)},
        {p + "zone": F.when(F.col(p + "ok"), F.regexp_extract(F.col(p + "s"), _ZONE, 1)),
         p + "parts": F.when(F.col(p + "ok"), F.split(time, "[-T: ]", -1))},
        {p + "local": F.when(F.col(p + "ok"), F.call_function(
            "try_make_timestamp_ntz", *[F.get(parts, i).cast("int") for i in range(5)],
            F.coalesce(F.get(parts, 5), F.lit("0")).cast("decimal(8,6)"))),
         p + "east": F.when(zone.isin("", "Z"), F.lit(0)).when(zone.startswith("-"), -minutes).otherwise(minutes)},
        {out: F.when(F.col(p + "east") == 0, F.col(p + "local")).otherwise(
            F.timestamp_add("MINUTE", -F.col(p + "east"), F.col(p + "local")))},
    ]


def add_iso_timestamp(df, src, out: str):
    return staged(df, *iso_timestamp_layers(src, out))


def iso_text(ts) -> Column:
    """Python ``datetime.isoformat()`` (fraction only when non-zero)."""
    ts = col_(ts)
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
    )


_EXIF_DT = r"^([0-9]{4}):([0-9]{1,2}):([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$"


def exif_datetime(v) -> Column:
    """EXIF 'YYYY:MM:DD HH:MM:SS' -> TIMESTAMP_NTZ, NULL when it is not valid."""
    v = col_(v)
    ok = v.rlike(_EXIF_DT)

    def g(i):
        return F.regexp_extract(v, _EXIF_DT, i).cast("int")

    return F.when(ok & (g(6) < 60), F.call_function(
        "try_make_timestamp_ntz", g(1), g(2), g(3), g(4), g(5), g(6).cast("decimal(8,6)")))


def exif_time_fields(v) -> tuple[Column, Column, Column]:
    """(timestamp text, date_taken, time_taken); unparsable -> raw text."""
    dt = exif_datetime(v)
    stamp = F.coalesce(F.concat(F.date_format(dt, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), col_(v))
    return stamp, F.date_format(dt, "yyyy-MM-dd"), F.date_format(dt, "HH:mm:ss")
