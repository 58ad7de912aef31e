"""Office documents read from bytes.

Spark has no Excel or Word source in this build, so ``binaryFile`` rows go
through ``mapInPandas`` into small standard-library decoders (``zipfile`` +
``xml.etree``). One file is one row: each decoder sees one document, Spark
spreads the files over the cluster, and everything after the decode (header
mapping, counts, joins) is DataFrame work.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_headers

# ---- fixed values: OOXML namespaces ----------------------------------------------
NS_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS_PKG_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
NS_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
NS_CP = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
NS_DC = "http://purl.org/dc/elements/1.1/"
NS_DCTERMS = "http://purl.org/dc/terms/"
# -----------------------------------------------------------------------------------


def _q(ns: str, tag: str) -> str:
    return f"{{{ns}}}{tag}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref or "")
    n = 0
    for ch in letters.group(0) if letters else "":
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _core_properties(z: zipfile.ZipFile) -> dict:
    """docProps/core.xml -> title, author (dc:creator), subject, created, modified."""
    if "docProps/core.xml" not in z.namelist():
        return {}
    root = ET.fromstring(z.read("docProps/core.xml"))
    out = {}
    for key, tag in (("title", _q(NS_DC, "title")), ("author", _q(NS_DC, "creator")),
                     ("subject", _q(NS_DC, "subject")), ("created", _q(NS_DCTERMS, "created")),
                     ("modified", _q(NS_DCTERMS, "modified"))):
        el = root.find(tag)
        if el is not None and el.text:
            text = el.text.strip()
            if key in ("created", "modified"):  # W3CDTF -> 'YYYY-MM-DD HH:MM:SS'
                text = text.replace("T", " ").rstrip("Z")
            out[key] = text
    return out


def _workbook_sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """[(sheet name, part path)] in workbook order."""
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.iter(_q(NS_PKG_REL, "Relationship"))}
    sheets = []
    for s in wb.iter(_q(NS_MAIN, "sheet")):
        t = target.get(s.get(_q(NS_REL, "id")), "")
        t = t.lstrip("/")
        sheets.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return sheets


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(_q(NS_MAIN, "t"))) for si in root.iter(_q(NS_MAIN, "si"))]


def _sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> list[list]:
    """Cell texts row by row (gaps filled with empty rows/None cells)."""
    root = ET.fromstring(z.read(part))
    rows: dict[int, dict[int, str]] = {}
    for r_i, row in enumerate(root.iter(_q(NS_MAIN, "row"))):
        r = int(row.get("r", r_i + 1)) - 1
        cells = {}
        for c_i, c in enumerate(row.iter(_q(NS_MAIN, "c"))):
            idx = _col_index(c.get("r")) if c.get("r") else c_i
            kind = c.get("t")
            v = c.find(_q(NS_MAIN, "v"))
            if kind == "s" and v is not None:
                val = shared[int(v.text)]
            elif kind == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(_q(NS_MAIN, "t")))
            elif kind == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text if v is not None else None
            cells[idx] = val
        rows[r] = cells
    if not rows:
        return []
    width = max((max(c) + 1 for c in rows.values() if c), default=0)
    return [[rows.get(i, {}).get(j) for j in range(width)] for i in range(max(rows) + 1)]


def _xlsx_first_sheet_rows(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name, part = _workbook_sheets(z)[0]
                    rows = _sheet_rows(z, part, _shared_strings(z))
                for i, cells in enumerate(rows):
                    out.append((path, i, cells, rows[0], None))
            except Exception as e:  # an unreadable workbook is one error row
                out.append((path, -1, None, None, f"Unreadable workbook: {e}"))
        yield pd.DataFrame(out, columns=["path", "row_index", "cells", "header", "error"])


XLSX_ROWS_SCHEMA = "path string, row_index long, cells array<string>, header array<string>, error string"


def xlsx_row_table(spark: SparkSession, paths) -> DataFrame:
    """A3 (long form): every row of each workbook's first sheet as an array."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_xlsx_first_sheet_rows, XLSX_ROWS_SCHEMA)


def read_xlsx_rows(spark: SparkSession, paths) -> DataFrame:
    """A3: first sheet, first row as header (pandas ``read_excel`` default),
    as a raw feed frame (``file_name``, ``row_no`` + text cells).

    The header comes from the first workbook (one feed per upload); one row
    per file reaches the driver for it."""
    rows = xlsx_row_table(spark, paths).where(F.col("error").isNull())
    head = rows.where(F.col("row_index") == 0).orderBy("path").select("cells").first()
    if head is None:
        raise ValueError("No rows in workbook")
    return _named_cells(rows, head["cells"])


#: Column with the reason why a workbook could not be read (headers are lower-cased, so it is none).
UNREADABLE = "Unreadable"


def _xlsx_file_name():
    return F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")


def _named_cells(rows: DataFrame, header) -> DataFrame:
    names = [h if h not in (None, "") else f"Unnamed: {i}" for i, h in enumerate(header)]
    return normalise_headers(rows.where(F.col("row_index") > 0).select(
        _xlsx_file_name(), (F.col("row_index") - 1).alias("row_no"),
        *[F.get(F.col("cells"), i).alias(n) for i, n in enumerate(names)],
    ))


def xlsx_frames(spark: SparkSession, paths) -> list[DataFrame]:
    """A3: a raw feed frame for each different header among the workbooks, found
    in one job, however many files there are. Workbooks that cannot be read come
    as a frame of their own, a row each, with the reason in ``UNREADABLE``; one
    without rows has no row anywhere."""
    rows = xlsx_row_table(spark, paths)
    kinds = rows.where("row_index <= 0").groupBy("header").agg(F.count_if(F.col("error").isNotNull()).alias("bad")).orderBy("header").collect()
    frames = [_named_cells(rows.where(F.col("header") == F.lit(k["header"]).cast("array<string>")), k["header"])
              for k in kinds if k["header"]]
    if any(k["bad"] for k in kinds):
        frames.append(rows.where(F.col("error").isNotNull()).select(
            _xlsx_file_name(), F.lit(0).cast("long").alias("row_no"), F.col("error").alias(UNREADABLE)))
    return frames


# ---- M5: workbook profile ----------------------------------------------------------

def _xlsx_profile(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    sheets = []
                    for name, part in _workbook_sheets(z):
                        root = ET.fromstring(z.read(part))
                        dim = root.find(_q(NS_MAIN, "dimension"))
                        ref = dim.get("ref") if dim is not None else None
                        if ref:
                            last = ref.split(":")[-1]
                            max_row = int(re.sub(r"[A-Z]+", "", last) or 1)
                            max_col = _col_index(last) + 1
                        else:
                            rows = _sheet_rows(z, part, [])
                            max_row, max_col = max(len(rows), 1), max((len(r) for r in rows), default=1)
                        sheets.append({"name": name, "max_row": max_row, "max_column": max_col})
                    props = _core_properties(z)
                props.pop("author", None)  # the workbook API has no 'author' attribute
                out.append((path, len(sheets), [s["name"] for s in sheets], sheets, props, None))
            except Exception as e:
                out.append((path, None, None, None, None, f"Unreadable workbook: {e}"))
        yield pd.DataFrame(out, columns=["path", "sheet_count", "sheet_names", "sheets_info", "properties", "error"])


XLSX_PROFILE_SCHEMA = ("path string, sheet_count int, sheet_names array<string>, "
                       "sheets_info array<struct<name:string, max_row:int, max_column:int>>, "
                       "properties map<string,string>, error string")


def xlsx_profile(files: DataFrame) -> DataFrame:
    """M5 (+ F8): sheet names and count, size of each sheet, properties."""
    return files.select("path", "content").mapInPandas(_xlsx_profile, XLSX_PROFILE_SCHEMA)


# ---- M4: document profile ----------------------------------------------------------

def _paragraph_text(p) -> str:
    parts = []
    for el in p.iter():
        if el.tag == _q(NS_W, "t"):
            parts.append(el.text or "")
        elif el.tag == _q(NS_W, "tab"):
            parts.append("\t")
        elif el.tag in (_q(NS_W, "br"), _q(NS_W, "cr")):
            parts.append("\n")
    return "".join(parts)


def _docx_profile(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ET.fromstring(z.read("word/document.xml"))
                    props = _core_properties(z)
                body = root.find(_q(NS_W, "body"))
                paras = body.findall(_q(NS_W, "p")) if body is not None else []
                tables = body.findall(_q(NS_W, "tbl")) if body is not None else []
                sections = sum(1 for _ in root.iter(_q(NS_W, "sectPr")))
                first = _paragraph_text(paras[0]) if paras else None
                out.append((path, len(paras), sections, len(tables), first, props, None))
            except Exception as e:
                out.append((path, None, None, None, None, None, f"Unreadable document: {e}"))
        yield pd.DataFrame(out, columns=["path", "paragraph_count", "section_count", "table_count",
                                         "first_paragraph_raw", "properties", "error"])


DOCX_PROFILE_SCHEMA = ("path string, paragraph_count int, section_count int, table_count int, "
                       "first_paragraph_raw string, properties map<string,string>, error string")


def docx_profile(files: DataFrame) -> DataFrame:
    """M4: paragraph/section/table counts, first paragraph (cut at 200 +
    '...', J24, done in Spark) and core properties."""
    from ..functions.text import preview

    prof = files.select("path", "content").mapInPandas(_docx_profile, DOCX_PROFILE_SCHEMA)
    return prof.withColumn("first_paragraph", preview(F.col("first_paragraph_raw"))).drop("first_paragraph_raw")


def document_info_map(info) -> F.Column:
    """Strip the leading '/' of every key and drop empty values (PDF
    document-information style maps)."""
    cleaned = F.map_filter(info, lambda k, v: v.isNotNull() & (v != ""))
    return F.transform_keys(cleaned, lambda k, v: F.regexp_replace(k, "^/", ""))


# ---- M7: combined document record --------------------------------------------------

# Content types of document suffixes.
DOCUMENT_TYPES = {"pdf": "application/pdf", "doc": "application/msword",
                  "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
                  "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}

UNSUPPORTED_DOCUMENT = "Unsupported file type. Supported types: .pdf, .doc, .docx, .xlsx"


def document_records(files: DataFrame, uploaded_at: str) -> DataFrame:
    """M7: one record per uploaded document: id, name, extension, upload
    time, storage (bucket/type/size, B6) and the extracted metadata of its
    kind (M4 for .docx, M5 for .xlsx). Other suffixes get the reference's
    'unsupported' error; PDF and legacy .doc decoding are not built (no
    decoder library here), their rows say so."""
    from ..functions.records import stable_uuid
    from ..operators.catalog import bucket_for, file_category
    from ..functions.text import file_extension

    f = files.select("path", "filename", "size", "content", file_extension(F.col("filename")).alias("ext"))
    docx = docx_profile(f.where(F.col("ext") == "docx")).select(
        "path", F.struct("paragraph_count", "section_count", "table_count", "first_paragraph").alias("docx"),
        F.col("properties").alias("_p1"), F.col("error").alias("_e1"))
    xl = xlsx_profile(f.where(F.col("ext") == "xlsx")).select(
        "path", F.struct("sheet_count", "sheet_names", "sheets_info").alias("xlsx"),
        F.col("properties").alias("_p2"), F.col("error").alias("_e2"))
    base = f.drop("content").join(docx, "path", "left").join(xl, "path", "left")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair])[F.col("ext")],
                      F.lit("application/octet-stream"))
    cat = file_category(kind)
    return base.select(
        stable_uuid(F.col("path")).alias("uuid"), "filename", F.concat(F.lit("."), F.col("ext")).alias("extension"),
        F.lit(uploaded_at).alias("upload_time"),
        kind.alias("content_type"),
        F.struct(bucket_for(cat, F.col("filename")).alias("bucket"), F.coalesce(cat, F.col("ext")).alias("type"),
                 F.col("size").alias("size")).alias("storage"),
        "docx", "xlsx", F.coalesce(F.col("_p1"), F.col("_p2")).alias("properties"),
        F.when(~F.col("ext").isin("docx", "xlsx", "pdf", "doc"), F.lit(UNSUPPORTED_DOCUMENT))
         .when(F.col("ext").isin("pdf", "doc"), F.lit("decoder not available for this type"))
         .otherwise(F.coalesce(F.col("_e1"), F.col("_e2"))).alias("error"),
    )
