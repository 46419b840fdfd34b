"""Formats by suffix. A reader turns one file's bytes into (page, line) pairs; Spark runs it by partition of files."""

from __future__ import annotations

import html
import io
import json
import logging
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[bytes], Iterator[tuple[int, str]]]
_READERS: dict[str, Reader] = {}
#: Suffix -> the pictures of a file, by the name that its lines give them.
_PICTURES: dict[str, Callable[[bytes], Iterator[tuple[str, bytes]]]] = {}
LINES = "document_key string, line_no int, page int, line string"
_BREAKS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def register(suffix: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        s = suffix.lower()
        if s in _READERS:
            logging.getLogger(__name__).warning("format %s is registered anew", s)
        _READERS[s] = reader
        return reader

    return add


def reader_for(suffix: str) -> Reader:
    try:
        return _READERS[suffix.lower()]
    except KeyError:
        raise ValueError(f"no reader for {suffix!r}; there are {', '.join(formats())}") from None


def formats() -> list[str]:
    return sorted(_READERS)


def _plain(data: bytes) -> Iterator[tuple[int, str]]:
    for page, part in enumerate(data.decode("utf-8-sig", "replace").split("\f"), 1):
        lines = _BREAKS.split(part)
        yield from ((page, x) for x in (lines[:-1] if lines[-1] == "" else lines))


for _s in (".txt", ".md", ".markdown"):
    register(_s)(_plain)


@register(".html")
def _html(data: bytes) -> Iterator[tuple[int, str]]:
    """Headings become ``#`` lines, other blocks a line each; scripts, styles and navigation go."""
    s = re.sub(r"(?is)<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->", "", data.decode("utf-8", "replace"))
    s = re.sub(r"(?is)^.*?<body[^>]*>", "", s)
    s = re.sub(r"(?i)<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", s)
    s = re.sub(r"(?i)</?(p|div|br|li|ul|ol|tr|table|article|section|h[1-6]|header|footer)\b[^>]*>", "\n", s)
    for line in html.unescape(re.sub(r"<[^>]*>", "", s)).split("\n"):
        if line.strip():
            yield 1, " ".join(line.split())


register(".htm")(_html)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
_EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"


def _parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Relation -> name in the archive, of what is there."""
    rels = "word/_rels/document.xml.rels"
    if rels not in z.namelist():
        return {}
    there = set(z.namelist())
    target = lambda t: t.lstrip("/") if t.startswith("/") else "word/" + t
    return {e.get("Id"): name for e in ET.fromstring(z.read(rels)) if (name := target(e.get("Target", ""))) in there}


def _docx_pictures(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, parts = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body"), _parts(z)
        names = [parts[e.get(_EMBED)] for p in (body.findall(f"{_W}p") if body is not None else ()) for e in p.iter(_BLIP) if e.get(_EMBED) in parts]
        for n, name in enumerate(names, 1):
            yield _picture(n, name), z.read(name)


def _picture(n: int, name: str) -> str:
    return f"docx_img_{n}.{name.rpartition('.')[2]}"


_PICTURES[".docx"] = _docx_pictures


@register(".docx")
def _docx(data: bytes) -> Iterator[tuple[int, str]]:
    """Body paragraphs, headings marked by style, bare numbers joined to their titles, a comment for each picture."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        parts = _parts(z)
        names = {}
        if "word/styles.xml" in z.namelist():
            for st in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                n = st.find(f"{_W}name")
                names[st.get(f"{_W}styleId")] = n.get(f"{_W}val", "") if n is not None else ""
    lines: list[str] = []
    pictures = 0
    for p in body.findall(f"{_W}p") if body is not None else ():
        for e in p.iter(_BLIP):
            if e.get(_EMBED) in parts:
                pictures += 1
                meta = {"temp_path": _picture(pictures, parts[e.get(_EMBED)]), "caption": f"Document Image {pictures}", "contained_text": []}
                lines.append(f"<!-- IMAGE: {json.dumps(meta)} -->")
        text = "".join(("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else e.text or "") for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")).strip()
        if not text:
            continue
        st = p.find(f"{_W}pPr/{_W}pStyle")
        style = names.get(st.get(f"{_W}val"), st.get(f"{_W}val")) if st is not None else ""
        m = re.fullmatch(r"(?i)heading (\d+)", style or "")
        runs = [r for r in p.iter(f"{_W}r") if "".join(t.text or "" for t in r.iter(f"{_W}t")).strip()]
        bold = runs and all((b := r.find(f"{_W}rPr/{_W}b")) is not None and b.get(f"{_W}val") not in ("0", "false") for r in runs)
        mark = "#" * int(m[1]) if m else {"title": "#", "subtitle": "##"}.get((style or "").lower(), "##" if not style and bold and len(text) < 80 else "")
        lines.append(f"{mark} {text}" if mark else text)
    bare = re.compile(r"\d+(?:\.\d+)*\.?")
    i = 0
    while i < len(lines):
        if bare.fullmatch(lines[i]) and i + 1 < len(lines) and not bare.fullmatch(lines[i + 1]):
            yield 1, f"{lines[i]} {lines[i + 1]}"
            i += 1
        else:
            yield 1, lines[i]
        i += 1


@register(".pdf")
def _pdf(data: bytes) -> Iterator[tuple[int, str]]:
    """Needs PyMuPDF, which is looked for only when a PDF is read."""
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF needs PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        for n, page in enumerate(doc, 1):
            yield from ((n, x) for x in page.get_text().splitlines())


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of all files, read by tasks; unknown suffixes fail when the plan is built if a single path has one."""
    for p in [paths] if isinstance(paths, str) else paths:
        if "*" not in p and (m := re.search(r"\.[A-Za-z0-9]+$", p)):
            reader_for(m[0])
    readers = dict(_READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                reader = readers.get("." + path.rpartition(".")[2].lower())
                if reader is None:
                    raise ValueError(f"no reader for {path}")
                rows = list(reader(data.as_py()))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["document_key", "line_no", "page", "line"])

    return spark.read.format("binaryFile").load(paths).select(F.col("path"), "content").mapInArrow(run, LINES)


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """document_key, temp_path, data of the pictures that the files hold."""
    readers = dict(_PICTURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                reader = readers.get("." + path.rpartition(".")[2].lower())
                for name, picture in reader(data.as_py()) if reader else ():
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([picture], pa.binary())], ["document_key", "temp_path", "data"])

    return spark.read.format("binaryFile").load(paths).select(F.col("path"), "content").mapInArrow(run, "document_key string, temp_path string, data binary")


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, nos, lines = [], [], []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, (_, line) in enumerate(_html((h or "").encode())):
                    keys.append(k)
                    nos.append(n)
                    lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nos, pa.int32()), pa.array([1] * len(nos), pa.int32()), pa.array(lines, pa.string())], ["document_key", "line_no", "page", "line"])

    return pages.select(F.col("page_id").cast("string").alias("k"), "html").mapInArrow(run, LINES)
