"""Small office files made from texts: the parsers' fixtures, and an export of a column of texts."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from heronry.schemas import FILES

_MAIN = "http://schemas.openxmlformats.org"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def docx(body: str) -> bytes:
    return _zip({"word/document.xml": f'<w:document xmlns:w="{_MAIN}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def docx_paragraph(text: str) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def pptx(slides: list[str]) -> bytes:
    ns = f'xmlns:p="{_MAIN}/presentationml/2006/main" xmlns:a="{_MAIN}/drawingml/2006/main" xmlns:r="{_MAIN}/officeDocument/2006/relationships"'
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(len(slides)))
    rels = "".join(f'<Relationship Id="rId{i}" Target="slides/slide{i}.xml"/>' for i in range(len(slides)))
    parts = {f"ppt/slides/slide{i}.xml": f"<p:sld {ns}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>" for i, s in enumerate(slides)}
    return _zip({"ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": f"<Relationships>{rels}</Relationships>", **parts})


def pptx_shape(text: str) -> str:
    return "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text.split("\n")) + "</p:txBody></p:sp>"


def xlsx(sheets: list[list[list[str]]], styles: str = "") -> bytes:
    """Sheets of rows of cell elements, each without its reference: ``t="n"><v>1</v>``; empty means none."""
    ns = f'xmlns="{_MAIN}/spreadsheetml/2006/main" xmlns:r="{_MAIN}/officeDocument/2006/relationships"'
    names = "".join(f'<sheet name="s{i}" sheetId="{i + 1}" r:id="rId{i}"/>' for i in range(len(sheets)))
    rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
    parts = {"xl/workbook.xml": f"<workbook {ns}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>"}
    for i, rows in enumerate(sheets):
        body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" {cell}</c>' for c, cell in enumerate(row) if cell) + "</row>" for r, row in enumerate(rows))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {ns}>{styles}</styleSheet>"
    return _zip(parts)


def xlsx_text(text: str) -> str:
    return f't="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is>'


def pdf(pages: list[str]) -> bytes:
    """Pages of Latin-1 text, a line of it for each line of the page."""
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    out = [b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n", f"2 0 obj<</Type/Pages/Kids [{kids}]/Count {len(pages)}>>endobj\n".encode()]
    for i, page in enumerate(pages):
        shown = b"".join(b"(" + line.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T* " for line in page.split("\n")) if page else b""
        raw = zlib.compress(b"BT " + shown + b"ET")
        out.append(f"{3 + 2 * i} 0 obj<</Type/Page/Parent 2 0 R/Contents {4 + 2 * i} 0 R>>endobj\n{4 + 2 * i} 0 obj<</Filter/FlateDecode/Length {len(raw)}>>stream\n".encode() + raw + b"\nendstream endobj\n")
    return b"".join([*out, b"trailer<</Root 1 0 R>>\n%%EOF"])


WRITERS: dict[str, tuple[str, Callable[[str, str], bytes]]] = {
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", lambda k, t: docx("".join(map(docx_paragraph, t.split("\n"))))),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", lambda k, t: pptx([pptx_shape(t)])),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", lambda k, t: xlsx([[[xlsx_text("text"), xlsx_text("n")], [xlsx_text(t), f't="n"><v>{k}</v>']]])),
    "pdf": ("application/pdf", lambda k, t: pdf([t, ""])),
}


def as_files(texts: DataFrame, kind: str) -> DataFrame:
    """Files (file_id, name, mime_type, content) of one kind from texts (file_id, text)."""
    mime, write = WRITERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [write(k, t or "") for k, t in zip(frame["file_id"], frame["text"])]
            yield pd.DataFrame({"file_id": frame["file_id"], "name": frame["file_id"] + f".{kind}", "mime_type": mime, "content": data})

    return texts.select("file_id", "text").mapInPandas(run, FILES)
