"""Tiny file builders for the file-level tests (standard library only)."""

import struct
import zipfile
import zlib

CORE = ('<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties '
        'xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" '
        'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'
        '<dc:title>{title}</dc:title><dc:creator>Ana</dc:creator>'
        '<dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>')


def xlsx(path, rows, title="Tracks", extra_sheet=True):
    shared = []

    def sidx(v):
        if v not in shared:
            shared.append(v)
        return shared.index(v)

    cells = []
    for r, row in enumerate(rows, start=1):
        cs = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                cs.append(f'<c r="{ref}" t="s"><v>{sidx(v)}</v></c>')
        cells.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    last = f"{chr(64 + max(len(r) for r in rows))}{len(rows)}"
    sheet = f'<worksheet {ns}><dimension ref="A1:{last}"/><sheetData>{"".join(cells)}</sheetData></worksheet>'
    sst = f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    sheets = '<sheet name="Data" sheetId="1" r:id="rId1"/>' + ('<sheet name="Notes" sheetId="2" r:id="rId2"/>' if extra_sheet else "")
    wb = (f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
          f"<sheets>{sheets}</sheets></workbook>")
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId2" Type="worksheet" Target="worksheets/sheet2.xml"/></Relationships>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData/></worksheet>')
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("docProps/core.xml", CORE.format(title=title))


def docx(path, paragraphs, tables=1, title="Report"):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" * tables
    doc = f"<w:document {w}><w:body>{body}<w:sectPr/></w:body></w:document>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", doc)
        z.writestr("docProps/core.xml", CORE.format(title=title))


def png(path, width=4, height=3):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + b"\xff\x00\x00" * width for _ in range(height))
    data = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    open(path, "wb").write(data)


def jpeg_with_exif(path, make="Acme", when="2024:03:05 10:20:30", width=8, height=6):
    """JPEG container with an APP1 EXIF block: Make, DateTime and GPS
    (N 10 30 0, W 20 15 36; altitude 0/0 = a zero denominator)."""
    entries0, entries_gps, blobs = [], [], b""
    # layout: header(8) + IFD0 (2 + 3*12 + 4) + GPS IFD (2 + 5*12 + 4) + data
    ifd0_off = 8
    gps_off = ifd0_off + 2 + 3 * 12 + 4
    data_off = gps_off + 2 + 5 * 12 + 4

    def put(b):
        nonlocal blobs
        off = data_off + len(blobs)
        blobs += b
        return off

    mk = make.encode() + b"\x00"
    dtb = when.encode() + b"\x00"
    entries0.append(struct.pack("<HHII", 0x010F, 2, len(mk), put(mk)))
    entries0.append(struct.pack("<HHII", 0x0132, 2, len(dtb), put(dtb)))
    entries0.append(struct.pack("<HHII", 0x8825, 4, 1, gps_off))
    lat = struct.pack("<IIIIII", 10, 1, 30, 1, 0, 1)
    lon = struct.pack("<IIIIII", 20, 1, 15, 1, 36, 1)
    entries_gps.append(struct.pack("<HHI4s", 1, 2, 2, b"N\x00\x00\x00"))
    entries_gps.append(struct.pack("<HHII", 2, 5, 3, put(lat)))
    entries_gps.append(struct.pack("<HHI4s", 3, 2, 2, b"W\x00\x00\x00"))
    entries_gps.append(struct.pack("<HHII", 4, 5, 3, put(lon)))
    entries_gps.append(struct.pack("<HHII", 6, 5, 1, put(struct.pack("<II", 0, 0))))
    tiff = (b"II*\x00" + struct.pack("<I", ifd0_off) + struct.pack("<H", 3) + b"".join(entries0) + b"\x00" * 4
            + struct.pack("<H", 5) + b"".join(entries_gps) + b"\x00" * 4 + blobs)
    app1 = b"Exif\x00\x00" + tiff
    sof = struct.pack(">BHHBBBB", 8, height, width, 3, 1, 0x11, 0) + b"\x02\x11\x01\x03\x11\x01"
    data = (b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1
            + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xd9")
    open(path, "wb").write(data)
