"""Office packages as tables: text of word and sheet files, and redacted copies. Codecs run on Arrow batches of whole files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import classify_part  # noqa: F401 - the policy over a table of parts

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
UNPACKED = 200 << 20
_PLAIN = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-", f"{W}softHyphen": "­"}


def _open(content: bytes) -> zipfile.ZipFile:
    package = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in package.infolist()) > UNPACKED:
        raise ValueError("the package unpacks to more than 200 MiB")
    return package


def docx_text(content: bytes) -> str:
    """Text of the document, then of headers, footers, notes and comments in path order; paragraphs end in \\n."""
    with _open(content) as package:
        parts = [n for n in package.namelist() if re.match(r"word/(header\d*|footer\d*|footnotes|endnotes|comments)\.xml$", n)]
        return "\n".join(_paragraphs(package.read(n)) for n in ["word/document.xml", *sorted(parts)])


def _paragraphs(xml: bytes) -> str:
    out = []
    for p in ET.fromstring(xml).iter(f"{W}p"):
        out.append("".join((e.text or "") if e.tag in (f"{W}t", f"{W}delText", f"{W}instrText") else _PLAIN.get(e.tag, "") for e in p.iter()))
    return "\n".join(out)


def xlsx_cells(content: bytes) -> list[tuple[str, str, str]]:
    """(sheet part, reference, text) of cells that hold text."""
    with _open(content) as package:
        names = package.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(package.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in names else []
        cells = []
        for part in sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)):
            for c in ET.fromstring(package.read(part)).iter(f"{S}c"):
                kind, v = c.get("t"), c.find(f"{S}v")
                text = shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else v.text if kind == "str" and v is not None else None
                if text:
                    cells.append((part, c.get("r") or "", text))
        return cells


def scrub_package(content: bytes, values: dict[str, str]) -> bytes:
    """A copy of the package with every value replaced in its text parts, longest first and whatever the case; dates and thumbnails go."""
    if not values:
        return content
    by_lower = {k.lower(): v for k, v in values.items()}
    alternatives = re.compile("|".join(re.escape(k) for k in sorted(values, key=lambda k: (-len(k), k))), re.IGNORECASE)
    put = lambda s: alternatives.sub(lambda m: by_lower[m[0].lower()], s) if s else s
    out = io.BytesIO()
    with _open(content) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as copy:
        for info in package.infolist():
            if re.search(r"thumbnail", info.filename, re.IGNORECASE):
                continue
            data = package.read(info)
            if info.filename.endswith((".xml", ".rels")):
                root = ET.fromstring(data)
                for group in [*root.iter(f"{W}p"), *root.iter(f"{S}si")]:
                    texts = [e for e in group.iter() if e.tag in (f"{W}t", f"{S}t")]
                    whole = "".join(e.text or "" for e in texts)
                    if texts and put(whole) != whole:  # a value may lie across runs: the first gets the new text
                        texts[0].text = put(whole)
                        for e in texts[1:]:
                            e.text = ""
                for e in root.iter():
                    e.text, e.tail = put(e.text), put(e.tail)
                    for a, v in e.attrib.items():
                        if len(v) >= 4 and re.search(r"[A-Za-z]{2}", v) and not v.startswith("http://schemas."):
                            e.set(a, put(v))
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            copy.writestr(zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, text, error): docx by paragraph, xlsx one cell a line; files that can't be read carry the reason."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_texts, "path string, text string, error string")


def _texts(batches):
    for batch in batches:
        rows = []
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                text = "\n".join(t for _, _, t in xlsx_cells(content)) if name.lower().endswith((".xlsx", ".xlsm")) else docx_text(content) if name.lower().endswith((".docx", ".docm")) else content.decode("utf-8")
                rows.append((name, text, None))
            except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the job
                rows.append((name, None, f"{type(e).__name__}: {e}"))
        paths, texts, errors = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])
