"""Image headers and EXIF tags from bytes.

``binaryFile`` rows go through one ``mapInPandas`` decoder that reads only
the container headers (PNG IHDR, JPEG SOF, TIFF/EXIF IFDs) with ``struct``:
no pixel decoding. The result is a long (file, tag, value) table that the
Catalyst-only operators of :mod:`tidewater.operators.media` fold.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import resolution, size_mb

# ---- fixed values: TIFF/EXIF tag names (public EXIF 2.3 specification) -----------
EXIF_TAG_NAMES = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation",
    0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x8769: "ExifOffset",
    0x8825: "GPSInfo", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x920A: "FocalLength",
}
GPS_TAG_NAMES = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude",
    5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp",
}
# TIFF field type -> byte size
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
# -----------------------------------------------------------------------------------


def _fmt_number(x: float) -> str:
    return repr(float(x))


def _read_ifd(tiff: bytes, offset: int, endian: str, names: dict, out: list, depth: int = 0):
    """Append (tag name, value text) of one IFD; follow EXIF and GPS pointers."""
    if depth > 2 or offset + 2 > len(tiff):
        return
    (count,) = struct.unpack_from(endian + "H", tiff, offset)
    for i in range(count):
        pos = offset + 2 + 12 * i
        if pos + 12 > len(tiff):
            break
        tag, typ, n, raw = struct.unpack_from(endian + "HHI4s", tiff, pos)
        size = TYPE_SIZES.get(typ)
        if size is None:
            continue
        total = size * n
        if total <= 4:
            data = raw[:total]
        else:
            (ptr,) = struct.unpack_from(endian + "I", raw)
            data = tiff[ptr:ptr + total]
        if tag in (0x8769, 0x8825) and typ in (4, 9):
            (sub,) = struct.unpack_from(endian + "I", raw)
            _read_ifd(tiff, sub, endian, GPS_TAG_NAMES if tag == 0x8825 else EXIF_TAG_NAMES, out, depth + 1)
            if tag == 0x8825:
                out.append(("GPSInfo", "present"))
            continue
        out.append((names.get(tag, str(tag)), _value_text(typ, n, data, endian)))


def _value_text(typ: int, n: int, data: bytes, endian: str):
    """Rationals -> numbers (zero denominator -> NULL, X13), lists ->
    space-joined, text without NULs, bytes cut at 200 characters + '...'."""
    if typ == 2:
        return data.split(b"\x00", 1)[0].decode("utf-8", errors="ignore")
    if typ in (5, 10):
        fmt = endian + ("I" if typ == 5 else "i") * 2
        vals = []
        for k in range(n):
            num, den = struct.unpack_from(fmt, data, 8 * k)
            if den == 0:
                return None
            vals.append(_fmt_number(num / den))
        return " ".join(vals)
    if typ in (3, 4, 9, 1):
        code = {3: "H", 4: "I", 9: "i", 1: "B"}[typ]
        vals = struct.unpack_from(endian + code * n, data)
        return " ".join(str(v) for v in vals)
    text = data.decode("utf-8", errors="ignore")
    return text[:200] + "..." if len(text) > 200 else text


def _exif_segment(content: bytes):
    """The TIFF block of a JPEG APP1 'Exif' segment, or of a TIFF file."""
    if content[:4] in (b"II*\x00", b"MM\x00*"):
        return content
    if content[:2] != b"\xff\xd8":
        return None
    i = 2
    while i + 4 <= len(content) and content[i] == 0xFF:
        marker = content[i + 1]
        (length,) = struct.unpack_from(">H", content, i + 2)
        if marker == 0xE1 and content[i + 4:i + 10] == b"Exif\x00\x00":
            return content[i + 10:i + 2 + length]
        if marker == 0xDA:
            break
        i += 2 + length
    return None


def exif_pairs(content: bytes) -> list[tuple[str, str]]:
    tiff = _exif_segment(content)
    if not tiff or len(tiff) < 8:
        return []
    endian = "<" if tiff[:2] == b"II" else ">"
    (ifd0,) = struct.unpack_from(endian + "I", tiff, 4)
    out: list = []
    _read_ifd(tiff, ifd0, endian, EXIF_TAG_NAMES, out)
    return out


def image_header(content: bytes):
    """(format, width, height, mode) from the container header, or Nones."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 26:
        w, h = struct.unpack_from(">II", content, 16)
        return "PNG", w, h, PNG_MODES.get(content[25])
    if content[:3] == b"\xff\xd8\xff":
        i = 2
        while i + 9 < len(content):
            if content[i] != 0xFF:
                i += 1
                continue
            marker = content[i + 1]
            if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
                i += 2
                continue
            (length,) = struct.unpack_from(">H", content, i + 2)
            if marker in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                h, w = struct.unpack_from(">HH", content, i + 5)
                return "JPEG", w, h, JPEG_MODES.get(content[i + 9])
            i += 2 + length
        return "JPEG", None, None, None
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        w, h = struct.unpack_from("<HH", content, 6)
        return "GIF", w, h, "P"
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack_from("<ii", content, 18)
        return "BMP", w, abs(h), None
    return None, None, None, None


def _decode(batches):
    for pdf in batches:
        heads, tags = [], []
        for path, content in zip(pdf["path"], pdf["content"]):
            fmt, w, h, mode = image_header(content)
            heads.append((path, fmt, w, h, mode))
            try:
                pairs = exif_pairs(content) if fmt else []
                err = None
            except (struct.error, IndexError, ValueError) as e:
                pairs, err = [], f"Error extracting EXIF data: {e}"
            tags.append((pairs, err))
        yield pd.DataFrame({
            "path": [x[0] for x in heads], "format": [x[1] for x in heads],
            "width": [x[2] for x in heads], "height": [x[3] for x in heads], "mode": [x[4] for x in heads],
            "tags": [[{"tag": t, "value": v} for t, v in p] for p, _ in tags],
            "error": [e for _, e in tags],
        })


DECODED_SCHEMA = ("path string, format string, width int, height int, mode string, "
                  "tags array<struct<tag:string, value:string>>, error string")


def decode_images(files: DataFrame) -> DataFrame:
    """One row per file: header fields + its EXIF (tag, value) list."""
    return files.select("path", "content").mapInPandas(_decode, DECODED_SCHEMA)


def image_profile(files: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """M1: format, mode, width, height, 'WxH' (J18), size in bytes and MB
    (J16); a file that is not a readable image gets ``error`` (C16)."""
    decoded = decoded if decoded is not None else decode_images(files)
    sized = files.select("path", F.col("filename"), F.col("size"))
    d = decoded.join(sized, "path")
    ok = F.col("format").isNotNull() & F.col("width").isNotNull()
    return d.select(
        "path", "filename", "format", "mode", "width", "height",
        resolution(F.col("width"), F.col("height")).alias("resolution"),
        F.col("size").alias("file_size_bytes"), size_mb(F.col("size")).alias("file_size_mb"),
        F.when(~ok, F.lit("File must be an image")).otherwise(F.col("error")).alias("error"),
    )


def exif_tag_table(decoded: DataFrame, uuid_col=None) -> DataFrame:
    """M2: the long EXIF table (file_uuid, filename, tag, value)."""
    fid = uuid_col if uuid_col is not None else F.col("path")
    return decoded.select(
        fid.alias("file_uuid"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.explode("tags").alias("t"),
    ).select("file_uuid", "filename", "t.tag", "t.value")
