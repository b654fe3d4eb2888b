"""Files in memory: word-processing documents, PDF files and archives, for sinks that write one file a row."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_NOT_XML = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])
_EPOCH = (1980, 1, 1, 0, 0, 0)


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of named members; equal members give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, _EPOCH), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A word-processing document; characters that XML can't hold go."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p.translate(_NOT_XML))}</w:t></w:r></w:p>' for p in paragraphs)
    return zip_bytes([("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_NS}"><w:body>{body}</w:body></w:document>'.encode("utf-8", "replace"))])


def pdf_bytes(pages: list[list[str]], title: str = "") -> bytes:
    """A PDF file of one page a list of lines: UTF-16 codes under one font whose map gives each code its character."""
    n = len(pages)
    hexed = lambda t: t.encode("utf-16-be", "replace").hex().encode()
    units = sorted({x[k : k + 4] for x in (hexed("".join(p)) for p in pages) for k in range(0, len(x), 4)})
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"".join(
        b"%d beginbfchar\n%s\nendbfchar\n" % (len(part), b"\n".join(b"<%s> <%s>" % (u, u) for u in part)) for part in (units[k : k + 100] for k in range(0, len(units), 100))
    )
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{6 + 2 * k} 0 R' for k in range(n))}] >>".encode()]
    objects += [b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 4 0 R >>"]
    objects += [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap), b"<< /Title <FEFF%s> >>" % hexed(title)]
    for k, lines in enumerate(pages):
        shown = b"BT /F1 12 Tf 40 800 Td 14 TL\n" + b"".join(b"<%s> Tj T*\n" % hexed(t) for t in lines) + b"ET"
        packed = zlib.compress(shown)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (7 + 2 * k))
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def docx(paragraphs: Column) -> Column:
    """A document's bytes from an array of paragraphs; null gives one without any."""
    return F.pandas_udf(_docx, "binary")(paragraphs)


def _docx(s: pd.Series) -> pd.Series:
    return s.map(lambda p: docx_bytes([] if p is None else list(p)))


def pdf(pages: Column, title: Column) -> Column:
    """A PDF file's bytes from an array of pages, each an array of lines, and a title."""
    return F.pandas_udf(_pdf, "binary")(pages, title)


def _pdf(pages: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([pdf_bytes([] if p is None else [list(x) for x in p], t or "") for p, t in zip(pages, title, strict=True)])


def archive(members: Column) -> Column:
    """An archive's bytes from an array of structs ``name, data``."""
    return F.pandas_udf(_archive, "binary")(members)


def _archive(s: pd.Series) -> pd.Series:
    return s.map(lambda ms: zip_bytes([] if ms is None else [(m["name"], bytes(m["data"])) for m in ms]))
