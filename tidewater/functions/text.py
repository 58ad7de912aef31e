"""Text helpers as Column expressions
and header normalisation (C9)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Characters that Python's str.strip()/str.split() treat as whitespace
# (Java's \s covers only the ASCII ones), as one regex character class.
WS = "[\\s\\u000b\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NOT_WS = "[^" + WS[1:]
# The same 29 characters as a plain string, for trimming without a regex.
WS_CHARS = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Cell texts that the pandas CSV/Excel readers turn into a missing value by
# default (pandas documentation, read_csv na_values).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# -----------------------------------------------------------------------------

_INT_RE = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def staged(df, *layers):
    """Add columns layer by layer; a layer may use earlier layers by name.

    Parsers reuse intermediate values many times. Written as one nested
    expression each reuse would be a copy of the whole subtree (generated code
    past the 64 KB method limit, and repeated regex work). As separate
    projections Catalyst keeps each expensive intermediate computed once
    (CollapseProject does not inline non-trivial expressions used twice), and
    whole-stage codegen still fuses the layers into one pipeline.
    """
    for layer in layers:
        df = df.select("*", *[c.alias(n) for n, c in layer.items()])
    return df


def merge_layers(*layer_lists):
    """Run several independent parsers side by side: layer k of each goes
    into the same projection, so the plan depth is that of the deepest
    parser, not the sum of all of them."""
    depth = max((len(x) for x in layer_lists), default=0)
    merged = []
    for k in range(depth):
        layer = {}
        for x in layer_lists:
            if k < len(x):
                layer.update(x[k])
        merged.append(layer)
    return merged


def numbers_layers(specs):
    """J12 for several columns at once.

    ``specs``: (source Column, output name, default or None, label). Output
    ``name`` is the DOUBLE (NULL or ``default`` when the text is missing or
    blank) and ``name + '_err'`` the reject reason for non-numeric text.
    """
    s1, s2 = {}, {}
    for src, name, default, label in specs:
        s1[f"_{name}_s"] = strip_cell(src.cast("string"))
    for src, name, default, label in specs:
        s = F.col(f"_{name}_s")
        blank = F.coalesce(s, F.lit("")) == ""
        is_num = s.rlike(_FLOAT_RE)
        value = F.when(is_num, s.cast("double"))
        if default is not None:
            value = F.when(blank, F.lit(float(default))).otherwise(value)
        s2[name] = value
        s2[f"{name}_err"] = F.when(~blank & ~F.coalesce(is_num, F.lit(False)),
                                   F.concat(F.lit(f"Invalid number for {label}: "), src.cast("string")))
    return [s1, s2]


def add_numbers(df, specs):
    return staged(df, *numbers_layers(specs))


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace incl. NBSP
    (``btrim`` with a character set: no regex per row)."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def strip_cell(c) -> Column:
    """:func:`strip_ws` of a plain column, named several times here: text that
    begins and ends with a visible ASCII character has nothing to strip."""
    c = col_(c)
    last = F.substring(c, -1, 1)
    bare = (c >= "!") & (c < "\u007f") & (last >= "!") & (last < "\u007f")
    return F.when(bare, c).otherwise(strip_ws(c))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NA_SQL_LIST = ", ".join(_sql_str(t) for t in NA_TOKENS)


def na_to_null(c) -> Column:
    """What a pandas text reader does to a cell: NA tokens become NULL.

    Given a column name, the test is one SQL expression (one call into the
    JVM instead of one per token; same plan: an IN over literals)."""
    if isinstance(c, str):
        q = "`" + c.replace("`", "``") + "`"
        return F.expr(f"CASE WHEN {q} IN ({_NA_SQL_LIST}) THEN CAST(NULL AS STRING) ELSE CAST({q} AS STRING) END")
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def text_or_empty(c) -> Column:
    """``str(x).strip()`` with a missing value read as ''."""
    return strip_ws(F.coalesce(col_(c).cast("string"), F.lit("")))


def blank_to_null(c) -> Column:
    s = strip_ws(col_(c))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def first_present(*cols) -> Column:
    """The first of several values that is present and not blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def is_int_text(c) -> Column:
    return col_(c).rlike(_INT_RE)


def is_float_text(c) -> Column:
    return col_(c).rlike(_FLOAT_RE)


def file_extension(name) -> Column:
    """``os.path.splitext(name)[1].lstrip('.').lower()``."""
    return F.lower(F.regexp_extract(col_(name), r"^(?:.*/)?\.*[^/.][^/]*\.([^./]*)$", 1))


def size_mb(size) -> Column:
    """Bytes to MB, two places."""
    return F.round(col_(size) / F.lit(1048576.0), 2)


def resolution(width, height) -> Column:
    """``f"{w}x{h}"``."""
    return F.concat_ws("x", col_(width).cast("string"), col_(height).cast("string"))


def preview(c, n: int = 200) -> Column:
    """First ``n`` characters plus '...' when longer."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


# Python whitespace that Java's \\s does not know, mapped to a space first.
_EXTRA_WS = "".join(ch for ch in WS_CHARS if ch not in " \t\n\u000b\u000c\r")


def to_ascii_space(c) -> Column:
    """Map the whitespace Python knows but Java's ``\\s`` does not to a
    plain space (a per-character translation, no regex)."""
    return F.translate(col_(c), _EXTRA_WS, " " * len(_EXTRA_WS))


def word_count(c) -> Column:
    """``len(text.split())`` -- runs of non-whitespace, no array built.
    The extra Unicode whitespace is translated to spaces (a character map)
    so the simple ``\\S+`` pattern counts exactly what Python splits on."""
    spaced = to_ascii_space(F.coalesce(col_(c), F.lit("")))
    return F.regexp_count(spaced, F.lit(r"\S+"))


def first_paragraph(c) -> Column:
    """Line 1 if it is not blank, else line 2, else ''."""
    lines = F.split(F.coalesce(col_(c), F.lit("")), "\n", 3)
    first = F.get(lines, 0)
    second = F.coalesce(F.get(lines, 1), F.lit(""))
    return F.when(strip_ws(first) != "", first).otherwise(second)


def is_all_digits(c) -> Column:
    """J28."""
    return col_(c).rlike("^[0-9]+$")


def lower_or_empty(c) -> Column:
    """J30."""
    return F.lower(F.coalesce(col_(c), F.lit("")))


# ---- header normalisation (C9), applied to column names on the driver -------

_PY_WS = re.compile(r"\s+")


def norm_header_structured(name: str) -> str:
    """Structured upload: strip, NBSP/tab -> space, collapse spaces, lower."""
    s = name.strip().replace("\u00a0", " ").replace("\t", " ")
    return _PY_WS.sub(" ", s).lower()


def norm_header_tracking(name: str) -> str:
    """Tracking converter: strip and lower only."""
    return name.strip().lower()


def norm_header_esm(name: str) -> str:
    """ESM converter: collapse whitespace, strip, lower, NBSP -> space."""
    return _PY_WS.sub(" ", name).strip().lower().replace("\u00a0", " ")


def normalise_headers(df, fn=norm_header_structured):
    """Rename every column with ``fn``; duplicate names after it are an error."""
    names = [fn(c) for c in df.columns]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"duplicate column names after normalising headers: {dupes}")
    return df.toDF(*names)
