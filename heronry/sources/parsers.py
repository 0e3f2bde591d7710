"""Text of office documents, read with the standard library's ZIP, XML and Flate support.

Order and emptiness are part of the result: slides and shapes come in order with empty text kept
and groups not entered; paragraphs of a document come before all table cells; a workbook is its
first sheet as CSV with the first row as header.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import scalars
from heronry.schemas import PARSED
from heronry.sources.dispatch import parser_of

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(p: ET.Element) -> str:
    """The text of a paragraph's runs; what formats it, such as its tab stops, is no text."""
    kinds = {_W + "t": lambda e: e.text or "", _W + "tab": lambda e: "\t", _W + "br": lambda e: "\n", _W + "cr": lambda e: "\n", _W + "noBreakHyphen": lambda e: "-"}
    return "".join(kinds[e.tag](e) for r in p.iter(_W + "r") for e in r if e.tag in kinds)


def docx(data: bytes) -> str:
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(_W + "body")
    paragraphs = [t for p in body.findall(_W + "p") if (t := _paragraph(p))]
    cells = ["\n".join(_paragraph(p) for p in c.findall(_W + "p")) for t in body.findall(_W + "tbl") for r in t.findall(_W + "tr") for c in r.findall(_W + "tc")]
    return "\n".join(paragraphs + cells)


def _relations(book: zipfile.ZipFile, part: str, base: str) -> dict[str, str]:
    root = ET.fromstring(book.read(part))
    join = lambda t: t.lstrip("/") if t.startswith("/") else f"{base}/{t}"
    return {r.get("Id"): join(r.get("Target")) for r in root}


def pptx(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    show = ET.fromstring(book.read("ppt/presentation.xml"))
    parts = _relations(book, "ppt/_rels/presentation.xml.rels", "ppt")
    out = []
    for slide in show.iter(_P + "sldId"):
        tree = ET.fromstring(book.read(parts[slide.get(_R + "id")])).find(f"{_P}cSld/{_P}spTree")
        for shape in tree.findall(_P + "sp"):
            lines = ["".join(("\v" if e.tag == _A + "br" else e.text or "") for e in p.iter() if e.tag in (_A + "t", _A + "br")) for p in shape.findall(f"{_P}txBody/{_A}p")]
            out.append("\n".join(lines))
    return "\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(_S + "numFmt")}
    dated = lambda k: 14 <= k <= 22 or 45 <= k <= 47 or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")), re.I))
    styles = root.find(_S + "cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if dated(int(x.get("numFmtId", 0)))}


# Cells that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _headers(found: list) -> list:
    """Column names: one that was there before gets the next free number, a missing one its place."""
    out, seen = [], {}
    for c, name in enumerate(found):
        name = f"Unnamed: {c}" if name is None or name == "" else name
        shown, k = name, seen.get(name, 0)
        while shown in seen:
            k += 1
            shown = f"{name}.{k}"
        seen[name] = max(k, seen.get(name, 0))
        seen.setdefault(shown, 0)
        out.append(shown)
    return out


def xlsx(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    about = ET.fromstring(book.read("xl/workbook.xml"))
    first, setting = about.find(f"{_S}sheets/{_S}sheet"), about.find(f"{_S}workbookPr")
    epoch = pd.Timestamp("1904-01-01" if setting is not None and setting.get("date1904") in ("1", "true") else "1899-12-30")
    sheet = ET.fromstring(book.read(_relations(book, "xl/_rels/workbook.xml.rels", "xl")[first.get(_R + "id")]))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(_S + "t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(_S + "si")]
    dates = _date_styles(book)
    rows: dict[int, dict[int, object]] = {}
    for r, row in enumerate(sheet.iter(_S + "row")):
        for c, cell in enumerate(row.findall(_S + "c")):
            kind, value = cell.get("t", "n"), cell.findtext(_S + "v")
            if kind == "inlineStr":
                found: object = "".join(t.text or "" for t in cell.iter(_S + "t"))
            elif value is None:
                continue
            elif kind == "s":
                found = shared[int(value)]
            elif kind == "b":
                found = value == "1"
            elif kind in ("str", "e", "d"):
                found = value
            else:
                found = float(value)
                if int(cell.get("s", -1)) in dates:
                    found = epoch + pd.Timedelta(days=found)
                elif found.is_integer():
                    found = int(found)
            rows.setdefault(int(row.get("r", r + 1)), {})[_column(cell.get("r")) if cell.get("r") else c] = found
    if not rows:
        return ""
    lowest, width = min(rows), 1 + max(max(r) for r in rows.values())
    head = _headers([rows[lowest].get(c) for c in range(width)])
    there = lambda v: None if isinstance(v, str) and v in MISSING else v
    body = [[there(rows.get(r, {}).get(c)) for c in range(width)] for r in range(lowest + 1, max(rows) + 1)]
    frame = pd.DataFrame({c: pd.Series([r[c] for r in body]).infer_objects() for c in range(width)})
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(head)
    frame.to_csv(out, index=False, header=False, lineterminator="\n")
    return out.getvalue()


_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: What a content stream is made of: strings, hexadecimal strings, names, numbers, brackets and operators.
_pdf_tokens = re.compile(rb"\(((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<([0-9A-Fa-f\s]*)>|/([^\s/<>\[\]()]*)|(-?\d*\.?\d+)|([\[\]])|([A-Za-z'\"*]+)", re.S)


def _pdf_bytes(m: re.Match) -> bytes:
    """The bytes of a string token."""
    if m[2] is not None:
        digits = re.sub(rb"\s", b"", m[2])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    one = lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else b"" if e[1] in (b"\n", b"\r\n") else _PDF_ESCAPES.get(e[1], e[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, m[1], flags=re.S)


class _Pdf:
    """Objects of a PDF by number, those in object streams included; the last of a number counts."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?:^|[\s>])(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S):
            number, body = int(m[1]), m[2]
            s = re.search(rb"stream\r?\n(.*?)endstream", body, re.S)
            self.objects[number] = body[: s.start()] if s else body
            if s:
                self.streams[number] = s[1]
        self.trailers = [*re.findall(rb"trailer(.*?)startxref", data, re.S), *(o for o in self.objects.values() if re.search(rb"/Type\s*/XRef\b", o))]
        if any(b"/Encrypt" in t for t in self.trailers):
            raise ValueError("an encrypted PDF")
        for number, body in list(self.objects.items()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                inside, first = self.stream(number), self.number(body, b"First")
                head = list(map(int, inside[:first].split()))
                ends = [*head[3::2], len(inside) - first]
                for k, at, end in zip(head[::2], head[1::2], ends):
                    self.objects[k] = inside[first + at : first + end]

    def number(self, body: bytes, name: bytes) -> int:
        return int(re.search(rb"/" + name + rb"\s+(\d+)", body)[1])

    def stream(self, number: int) -> bytes:
        body, raw = self.objects.get(number, b""), self.streams.get(number, b"")
        filters = re.search(rb"/Filter\s*(\[.*?\]|/\w+)", body, re.S)
        for name in re.findall(rb"/(\w+)", filters[1]) if filters else []:
            if name != b"FlateDecode":
                raise ValueError(f"a PDF stream with {name.decode()}")
            # the line end before endstream is no data, yet data may end in bytes that look like one: Flate tells where it ends
            flate = zlib.decompressobj()
            raw = flate.decompress(raw)
            if not flate.eof:
                raise ValueError("a PDF stream that is cut off")
        return raw

    def value(self, body: bytes, name: bytes) -> bytes:
        """What a name stands for in a dictionary, with one reference followed; empty if it is not there."""
        m = re.search(rb"/" + name + rb"\b\s*(?:(\d+)\s+\d+\s+R|(<<)|(\[[^\]]*\])|(/?[^\s/<>\[\]]+))", body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        if m[2]:
            depth, at = 0, m.start(2)
            for e in re.finditer(rb"<<|>>", body[at:]):
                depth += 1 if e[0] == b"<<" else -1
                if not depth:
                    return body[at : at + e.end()]
        return m[3] or m[4] or b""

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """Pages in order with the resources they have or inherit."""
        root = next((m[1] for t in reversed(self.trailers) if (m := re.search(rb"/Root\s+(\d+)\s+\d+\s+R", t))), None)
        catalog = self.objects.get(int(root), b"") if root else next((o for o in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", o)), b"")
        top = self.value(catalog, b"Pages")
        if not top:
            raise ValueError("a PDF without a page tree")
        pending, seen = [(top, b"")], 0
        while pending:
            node, resources = pending.pop()
            resources = self.value(node, b"Resources") or resources
            seen += 1
            if seen > len(self.objects) + 1:
                raise ValueError("a page tree with a cycle")
            if re.search(rb"/Kids\b", node):
                kids = [self.objects.get(int(k), b"") for k in re.findall(rb"(\d+)\s+\d+\s+R", self.value(node, b"Kids"))]
                pending += [(k, resources) for k in reversed(kids)]
            else:
                yield node, resources

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Of each font with a ToUnicode map the bytes of a code and the text of each code."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            font = self.objects.get(int(number), b"")
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font)
            if to:
                out[name] = self.unicode_map(self.stream(int(to[1])))
            elif re.search(rb"/Subtype\s*/Type0\b", font):
                raise ValueError("a composite PDF font without a map to Unicode")
        return out

    def unicode_map(self, cmap: bytes) -> tuple[int, dict[int, str]]:
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
        found: dict[int, str] = {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            found |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, first, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
                low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
                several = re.findall(rb"<([0-9A-Fa-f]+)>", listed)
                for k in range(low, high + 1):
                    if first:
                        base = text(first)
                        found[k] = base[:-1] + chr(ord(base[-1]) + k - low)
                    elif k - low < len(several):
                        found[k] = text(several[k - low])
        return (len(space[1]) // 2 if space else 1), found


def _pdf_page(pdf: _Pdf, page: bytes, resources: bytes) -> str:
    """The strings that a page shows, with a line feed where the text position moves to another line."""
    contents = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", page, re.S)
    numbers = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", contents[1] or contents[2])] if contents else []
    parts = [n for k in numbers for n in ([k] if k in pdf.streams else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", pdf.objects.get(k, b""))])]
    fonts, width, known = pdf.fonts(resources), 1, {}
    lines, line, held = [], [], []

    def shown(raw: bytes) -> str:
        if not known:
            return raw.decode("latin-1")
        codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
        return "".join(known.get(c, chr(c) if width == 1 else "\ufffd") for c in codes)

    for m in _pdf_tokens.finditer(b"\n".join(pdf.stream(k) for k in parts)):
        operator = m[6]
        if operator is None:
            held.append(m)
            continue
        if operator == b"Tf":
            names = [h[3] for h in held if h[3] is not None]
            width, known = fonts.get(names[-1], (1, {})) if names else (1, {})
        elif operator in (b"T*", b"Td", b"TD", b"ET", b"'", b'"') and line:
            lines.append("".join(line))
            line = []
        if operator in (b"Tj", b"TJ", b"'", b'"'):
            line += [shown(_pdf_bytes(h)) for h in held if h[1] is not None or h[2] is not None]
        held = []
    return "\n".join(lines + (["".join(line)] if line else []))


def pdf(data: bytes) -> str:
    """Text shown by the pages' content streams, in page order. Pages without text are left out.

    What cannot be read without loss (encryption, other filters than Flate, composite fonts
    without a map) is an error, so no text goes missing silently.
    """
    found = _Pdf(data)
    return "\n".join(t for page, resources in found.pages() if (t := _pdf_page(found, page, resources)))


PARSERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf, "pptx": pptx, "docx": docx, "xlsx": xlsx}


def parse_one(kind: str, data: bytes | None) -> tuple[str, str | None, str | None]:
    """(status, content, message): a file that cannot be read is an error row, never a failed job."""
    try:
        return "success", PARSERS[kind](data or b""), None
    except Exception as e:  # noqa: BLE001  whatever a damaged file makes the parsers raise
        return "error", None, f"{type(e).__name__}: {e}"


def parse_files(files: DataFrame) -> DataFrame:
    """Status, title and content (whole) of files (file_id, name, mime_type, content)."""
    kinds = files.select("file_id", "name", "mime_type", "content", parser_of(F.col("mime_type"), F.col("name")).alias("kind"))
    message = F.concat(F.lit("Unsupported file type: "), F.coalesce("mime_type", F.lit("")))
    refused = kinds.where("kind = 'unsupported'").select("file_id", F.lit("error").alias("status"), F.col("name").alias("title"), F.lit(None).cast("string").alias("content"), message.alias("message"))

    text = scalars.decode_utf8(F.col("content"))
    native = kinds.where("kind = 'native'").select("file_id", F.when(text.isNull(), "error").otherwise("success").alias("status"), F.col("name").alias("title"), text.alias("content"), F.when(text.isNull(), "not UTF-8").alias("message"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [parse_one(k, bytes(c) if c is not None else None) for k, c in zip(frame["kind"], frame["content"])]
            yield pd.DataFrame({"file_id": frame["file_id"], "status": [f[0] for f in found], "title": frame["name"], "content": [f[1] for f in found], "message": [f[2] for f in found]})

    return kinds.where("kind not in ('unsupported', 'native')").mapInPandas(run, PARSED).unionByName(native).unionByName(refused)


def read_folder(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """The files under a path as FILES: their path as id, their name, and a MIME type by suffix where ``types`` has it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix, mime = F.lower(F.element_at(F.split(name, r"\."), -1)), F.lit("")
    for ending, kind in (types or {}).items():
        mime = F.when(suffix == ending, kind).otherwise(mime)
    return rows.select(F.col("path").alias("file_id"), name.alias("name"), mime.alias("mime_type"), "content")


def document_content(files: DataFrame, link: str, whole: bool = False) -> DataFrame:
    """The parsed file behind a link, its content cut to the limit unless ``whole``; no row if the link has no id."""
    parsed = parse_files(files.where(F.col("file_id") == scalars.file_id(F.lit(link))))
    return parsed if whole else parsed.withColumn("content", scalars.truncate(F.col("content")))
