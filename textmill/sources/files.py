"""Files: type detection, text with its encoding, office documents, e-books and PDF, as rows with text, metadata and error."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources.web import parse_html

#: Extensions and the kinds of file they mean.
KINDS = {
    ".pdf": "pdf", ".docx": "office", ".doc": "office", ".xlsx": "office", ".xls": "office", ".pptx": "office", ".ppt": "office", ".odt": "office", ".ods": "office", ".odp": "office",
    ".epub": "ebook", ".mobi": "ebook", ".azw3": "ebook", ".azw": "ebook", ".txt": "text", ".md": "text", ".rtf": "text",
}
MAX_TEXT = 100 * 1024 * 1024
SCHEMA = "text string, metadata map<string,string>, error string"
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, dict[str, str]]]] = {}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind_of(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), extension(path))


def register_extractor(ext: str, f: Callable[[bytes], tuple[str, dict[str, str]]]) -> None:
    """``f`` reads files that end in ``ext``; it gives text and metadata."""
    EXTRACTORS[ext] = f


def decode(data: bytes, encoding: str = "auto") -> tuple[str, dict[str, str]]:
    """In the encoding that is given; auto: by byte-order mark, else UTF-8 if it is valid, else Latin-1."""
    if encoding != "auto":
        return data.decode(encoding, "ignore"), {"encoding": encoding}
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(enc, "ignore"), {"encoding": enc}
    try:
        return data.decode("utf-8"), {"encoding": "utf-8"}
    except UnicodeDecodeError:
        return data.decode("latin-1"), {"encoding": "latin-1"}


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(e: ET.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == name)


def _properties(z: zipfile.ZipFile, path: str) -> dict[str, str]:
    if path not in z.namelist():
        return {}
    return {_local(e): e.text.strip() for e in ET.fromstring(z.read(path)).iter() if e.text and e.text.strip()}


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(data: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs that are not blank, table rows with tabs, headers, footers and comments."""
    z = zipfile.ZipFile(BytesIO(data))
    out: list[str] = []
    body = next(e for e in ET.fromstring(z.read("word/document.xml")) if _local(e) == "body")
    for e in body:
        if _local(e) == "p" and _texts(e).strip():
            out.append(_texts(e))
        elif _local(e) == "tbl":
            out += ["\t".join(_texts(c) for c in r if _local(c) == "tc") for r in e if _local(r) == "tr"]
    for label, pattern in (("Header", r"word/header(\d+)\.xml"), ("Footer", r"word/footer(\d+)\.xml")):
        out += [f"[{label}: {t}]" for n in _numbered(z, pattern) if (t := _texts(ET.fromstring(z.read(n))).strip())]
    if "word/comments.xml" in z.namelist():
        out += [f"[Comment: {_texts(c)}]" for c in ET.fromstring(z.read("word/comments.xml")) if _texts(c).strip()]
    return "\n".join(out), _properties(z, "docProps/core.xml")


def xlsx(data: bytes) -> tuple[str, dict[str, str]]:
    """Sheets by name, rows of the cells that are not empty with tabs."""
    z = zipfile.ZipFile(BytesIO(data))
    shared = [_texts(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [e.get("name", "") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
    out: list[str] = []
    for name, path in zip(names, _numbered(z, r"xl/worksheets/sheet(\d+)\.xml")):
        out.append(f"\n[Sheet: {name}]")
        for row in (e for e in ET.fromstring(z.read(path)).iter() if _local(e) == "row"):
            cells = []
            for c in row:
                v = next((x.text for x in c.iter() if _local(x) == "v"), None)
                if c.get("t") == "s" and v is not None:
                    v = shared[int(v)]
                elif c.get("t") == "inlineStr":
                    v = _texts(c)
                if v not in (None, ""):
                    cells.append(v)
            if cells:
                out.append("\t".join(cells))
    return "\n".join(out), {**_properties(z, "docProps/core.xml"), "sheet_count": str(len(names))}


def pptx(data: bytes) -> tuple[str, dict[str, str]]:
    """Slides by number, paragraphs of shapes, table rows with bars, notes."""
    z = zipfile.ZipFile(BytesIO(data))
    slides = _numbered(z, r"ppt/slides/slide(\d+)\.xml")
    out: list[str] = []
    for i, path in enumerate(slides, 1):
        out.append(f"\n[Slide {i}]")
        tree = ET.fromstring(z.read(path))
        for e in tree.iter():
            if _local(e) == "sp":
                out += [t for p in e.iter() if _local(p) == "p" and (t := _texts(p)).strip()]
            elif _local(e) == "tr":
                out.append(" | ".join(_texts(c) for c in e if _local(c) == "tc"))
        note = f"ppt/notesSlides/notesSlide{i}.xml"
        if note in z.namelist() and (t := _texts(ET.fromstring(z.read(note))).strip()):
            out.append(f"[Notes: {t}]")
    return "\n".join(out), {**_properties(z, "docProps/core.xml"), "slide_count": str(len(slides))}


def opendocument(data: bytes) -> tuple[str, dict[str, str]]:
    """Headings, paragraphs and table rows of odt, ods and odp."""
    z = zipfile.ZipFile(BytesIO(data))
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        name = _local(e)
        if name == "table-row":
            cells = ["".join(c.itertext()).strip() for c in e if _local(c) == "table-cell"]
            if any(cells):
                out.append("\t".join(c for c in cells if c))
        elif name in ("p", "h"):
            if t := "".join(e.itertext()).strip():
                out.append(t)
        else:
            for c in e:
                walk(c)

    walk(ET.fromstring(z.read("content.xml")))
    return "\n".join(out), _properties(z, "meta.xml")


def epub(data: bytes) -> tuple[str, dict[str, str]]:
    """Chapters in the order of the spine, by file name; title, creator, language and publisher."""
    z = zipfile.ZipFile(BytesIO(data))
    opf = next(e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
    tree = ET.fromstring(z.read(opf))
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {e.get("id"): e.get("href") for e in tree.iter() if _local(e) == "item"}
    out = []
    for ref in (e.get("idref") for e in tree.iter() if _local(e) == "itemref"):
        if href := items.get(ref):
            text = "\n".join(parse_html(z.read(base + href).decode("utf-8", "replace")).text)
            if text:
                out.append(f"\n[Chapter: {href}]\n{text}")
    meta = {_local(e): e.text.strip() for e in tree.iter() if _local(e) in ("title", "creator", "language", "publisher") and e.text}
    return "\n".join(out), {**meta, "chapters": str(len(out))}


def pdf(data: bytes) -> tuple[str, dict[str, str]]:
    """Needs one of the PDF libraries; without any the row has an error."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("no PDF library is installed; register an extractor for .pdf") from e
    r = pypdf.PdfReader(BytesIO(data))
    return "\n".join(p.extract_text() or "" for p in r.pages), {"page_count": str(len(r.pages)), **{k.strip("/").lower(): str(v) for k, v in (r.metadata or {}).items()}}


BUILT_IN = {".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".odt": opendocument, ".ods": opendocument, ".odp": opendocument, ".epub": epub, ".pdf": pdf, ".txt": decode, ".md": decode, ".rtf": decode}


def extract(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, encoding: str = "auto") -> DataFrame:
    """A row for each file of a known kind in ``path``: id, source, kind, file_name, file_size, file_modified, text, metadata, error (null if it went well),
    extractor and extraction_time. ``encoding`` is that of text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    files = files.withColumn("kind", kind_of(F.col("path"))).filter("kind is not null").withColumn("ext", extension(F.col("path")))
    readers = {**BUILT_IN, **EXTRACTORS}

    def of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for e, size, data in zip(p["ext"], p["length"], p["content"]):
                try:
                    if e in (".txt", ".md", ".rtf") and size > MAX_TEXT:
                        raise ValueError("File too large")
                    if e not in readers:
                        raise ValueError(f"no extractor for {e}")
                    text, meta = decode(data, encoding) if readers[e] is decode else readers[e](data)
                    rows.append((text, meta, None))
                except Exception as x:  # a broken file is a row, not a failed job
                    rows.append(("", {}, f"{type(x).__name__}: {x}"))
            yield pd.concat([p.drop(columns=["content"]).reset_index(drop=True), pd.DataFrame(rows, columns=["text", "metadata", "error"])], axis=1)

    cols = files.select(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 16).alias("id"), F.col("path").alias("source"), "kind", "ext", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", F.col("modificationTime").alias("file_modified"), "content")
    out = cols.mapInPandas(of, f"id string, source string, kind string, ext string, file_name string, length long, file_modified timestamp, {SCHEMA}")
    return out.withColumnRenamed("length", "file_size").withColumn("extractor", F.col("kind")).withColumn("extraction_time", F.current_timestamp())
