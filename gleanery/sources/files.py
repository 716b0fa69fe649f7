"""File content: reading, container checks and text extraction.

Bytes must be parsed here, so this is the place of Python on the executors:
batches of Arrow rows, one file at a time, every failure caught in its row.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import signal
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.encoding import detect_bytes, head_bytes
from gleanery.sources.mime import BY_ZIP_EXTENSION, mime_of

TIMEOUT_S = 30
OFFICE = tuple(BY_ZIP_EXTENSION.values())
EXTRACTABLE = ("application/pdf", *OFFICE, "application/epub+zip", "message/rfc822")
PLAIN = ("text/plain", "text/csv", "text/json", "text/xml", "application/json", "application/xml")
FACTS = (
    "path string, mime string, text string, encoding string, enc_confidence double, text_length int, page_count int, scanned_pages int, native_pages int, image_pages int,"
    " title string, author string, creation_date string, error string"
)


def read_content(files: DataFrame) -> DataFrame:
    """Adds content (null where it cannot be read) and mime to listed files; no driver involved."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    with open(path, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield frame.assign(content=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields) + ", content binary"
    return files.mapInPandas(load, schema).withColumn("mime", mime_of(F.col("relative_path"), F.col("content")))


def container_facts(raw: bytes | None, extension: str, mime: str) -> tuple[bool, bool, str | None]:
    """zip_encrypted, office_encrypted, ooxml_error."""
    if not raw:
        return False, False, None
    office = extension in BY_ZIP_EXTENSION or mime in OFFICE
    if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return False, office and ("EncryptedPackage".encode("utf-16-le") in raw or b"EncryptedPackage" in raw), None
    if raw[:4] != b"PK\x03\x04":
        return False, False, None
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            locked = any(m.flag_bits & 1 for m in z.infolist())
            if mime not in OFFICE or locked:
                return locked, False, None
            bad = z.testzip()
            if bad:
                return locked, False, f"CRC mismatch in {bad}"
            return locked, False, None if "[Content_Types].xml" in z.namelist() else "no [Content_Types].xml"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as e:
        return len(raw) > 7 and bool(raw[6] & 1), False, str(e) if mime in OFFICE else None


def with_container_facts(files: DataFrame) -> DataFrame:
    """Adds what ``operators.health.file_health`` needs from inside containers."""

    @F.pandas_udf("zip_encrypted boolean, office_encrypted boolean, ooxml_error string")
    def facts(content: pd.Series, path: pd.Series, mime: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, p, m in zip(content, path, mime, strict=True):
            ext = "." + p.rsplit(".", 1)[-1].lower() if "." in p else ""
            rows.append(container_facts(raw, ext, m))
        return pd.DataFrame(rows, columns=["zip_encrypted", "office_encrypted", "ooxml_error"])

    return files.withColumn("__c", facts("content", "path", "mime")).select("*", "__c.*").drop("__c")


def _nodes(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(z.read(name))
    except KeyError:
        return None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ET.Element) -> list[str]:
    """Text of each paragraph element, in document order."""
    out = []
    for p in root.iter():
        if _local(p.tag) == "p":
            out.append("".join(t.text or "" if _local(t.tag) == "t" else "\t" if _local(t.tag) == "tab" else "" for t in p.iter()))
    return out


def _core(z: zipfile.ZipFile) -> dict:
    root = _nodes(z, "docProps/core.xml")
    found = {_local(e.tag): e.text for e in root} if root is not None else {}
    return {"title": found.get("title"), "author": found.get("creator"), "creation_date": found.get("created")}


def docx(raw: bytes) -> dict:
    """Body paragraphs outside tables, then cells, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = _nodes(z, "word/document.xml")
        body = next((e for e in root.iter() if _local(e.tag) == "body"), root) if root is not None else None
        parts, cells = [], []
        for e in body if body is not None else ():
            if _local(e.tag) == "p":
                parts += _paragraphs(ET.ElementTree(e).getroot()) or []
            elif _local(e.tag) == "tbl":
                cells += ["\n".join(_paragraphs(c)) for c in e.iter() if _local(c.tag) == "tc"]
        edges = [n for n in sorted(z.namelist()) if re.fullmatch(r"word/(header|footer)\d*\.xml", n)]
        for n in edges:
            cells += _paragraphs(_nodes(z, n))
        return {"text": "\n".join([*parts, *cells]), "page_count": 0, **_core(z)}


def xlsx(raw: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared_root = _nodes(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in shared_root] if shared_root is not None else []
        lines = []
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for name in sheets:
            for row in (e for e in _nodes(z, name).iter() if _local(e.tag) == "row"):
                values = []
                for c in row:
                    v = next((x.text for x in c if _local(x.tag) == "v"), None)
                    inline = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    value = shared[int(v)] if c.get("t") == "s" and v is not None else inline if c.get("t") == "inlineStr" else v
                    if value is not None:
                        values.append(value)
                if values:
                    lines.append("\t".join(values))
        return {"text": "\n".join(lines), "page_count": 0, **_core(z)}


def pptx(raw: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        text = [p for n in slides for p in _paragraphs(_nodes(z, n)) if p]
        return {"text": "\n".join(text), "page_count": len(slides), **_core(z)}


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_nodes(text: str) -> list[str]:
    """Stripped text nodes that are not blank; scripts and styles included."""
    parser = _Nodes()
    parser.feed(text)
    parser.close()
    return parser.parts


def epub(raw: bytes) -> dict:
    """All pages in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        pages = [html_nodes(z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return {"text": "\n".join(part for page in pages for part in page), "page_count": 0}


def eml(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = [f"{k}: {m[k]}" for k in ("Subject", "From", "To", "Date") if m[k]]
    body = m.get_body(("plain", "html"))
    return {"text": "\n".join([*head, body.get_content() if body else ""]), "page_count": 0, "title": m["Subject"], "author": m["From"], "creation_date": m["Date"]}


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)endstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|Td|TD", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PDF_ESCAPES.get(m[1], m[1])

    value = re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S)
    return value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("latin-1")


def pdf(raw: bytes) -> dict:
    """A small reader: text operators of plain and deflated content streams with one-byte fonts.

    Pages without text count as scanned; images are told by their objects.
    """
    if b"/Encrypt" in raw:
        raise ValueError("encrypted")
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", raw))
    texts = []
    for head, data in _STREAM.findall(raw):
        if b"/Subtype" in head and b"/Image" in head:
            continue
        if b"FlateDecode" in head:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"Tj" not in data and b"TJ" not in data and b"BT" not in data:
            continue
        parts = []
        for m in _SHOW.findall(data):
            strings = "".join(_pdf_string(s) for s in _STRING.findall(m))
            parts.append(strings if strings else "\n")
        texts.append("".join(parts).strip())
    info = {k: re.search(rb"/" + n + rb"\s*(\((?:\\.|[^\\()])*\))", raw, re.S) for k, n in (("title", b"Title"), ("author", b"Author"), ("creation_date", b"CreationDate"))}
    native = min(sum(1 for t in texts if t), pages) if pages else sum(1 for t in texts if t)
    images = len(re.findall(rb"/Subtype\s*/Image", raw))
    return {
        "text": "\n".join(t for t in texts if t), "page_count": pages, "native_pages": native, "scanned_pages": max(0, pages - native), "image_pages": min(images, max(0, pages - native)),
        **{k: _pdf_string(m[1]) if m else None for k, m in info.items()},
    }


READERS: dict[str, Callable[[bytes], dict]] = {
    "application/pdf": pdf, OFFICE[0]: docx, OFFICE[1]: xlsx, OFFICE[2]: pptx, "application/epub+zip": epub, "message/rfc822": eml,
}


class _Deadline:
    """Ends work on one file after TIMEOUT_S, where signals can do that (a worker's main thread)."""

    def __enter__(self) -> None:
        def stop(*_: object) -> None:
            raise TimeoutError(f"more than {TIMEOUT_S} s")

        try:
            self.old = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, TIMEOUT_S)
        except ValueError:
            self.old = None

    def __exit__(self, *_: object) -> None:
        if self.old is not None:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.old)


def extract_one(raw: bytes | None, mime: str, max_bytes: int | None = None) -> dict:
    """The facts of one file; never raises. Of plain text ``max_bytes`` are read, or all."""
    try:
        if raw is None:
            raise ValueError("content cannot be read")
        with _Deadline():
            if mime in PLAIN:
                text, encoding, sure = detect_bytes(head_bytes(raw, max_bytes))
                return {"text": text, "encoding": encoding, "enc_confidence": sure, "page_count": 0}
            if mime not in READERS:
                raise ValueError(f"Unsupported type: {mime}")
            return READERS[mime](raw)
    except Exception as e:  # noqa: BLE001 - one file's failure is that file's result
        return {"error": f"{e}" or type(e).__name__}


def extract(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """path and the facts of each file (path, mime, content) whose type holds text, in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "mime", "text", "encoding", "enc_confidence", "text_length", "page_count", "scanned_pages", "native_pages", "image_pages", "title", "author", "creation_date", "error"]
        for frame in frames:
            rows = []
            for path, mime, raw in zip(frame["path"], frame["mime"], frame["content"], strict=True):
                facts = extract_one(bytes(raw) if raw is not None else None, mime, max_bytes)
                facts |= {"path": path, "mime": mime, "text_length": len(facts.get("text") or "")}
                row = {n: facts.get(n) for n in names}
                for n in ("page_count", "scanned_pages", "native_pages", "image_pages"):
                    row[n] = int(row[n] or 0)
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("mime").isin(*EXTRACTABLE, *PLAIN)).select("path", "mime", "content").mapInPandas(run, FACTS)


def classify(facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds chars_per_page, text_size_ratio, is_scanned, is_mixed_scan, classification, extraction_quality."""
    rows = facts.join(sizes.select("path", "size"), "path")
    pages = F.col("page_count")
    per_page = F.when(pages > 0, F.col("text_length") / pages).otherwise(F.col("text_length").cast("double"))
    rows = rows.withColumns({"chars_per_page": per_page, "text_size_ratio": F.when(F.col("size") > 0, F.col("text_length") / F.col("size")).otherwise(0.0)})
    is_pdf = F.col("mime") == "application/pdf"
    dominated = (pages > 0) & (F.col("image_pages") >= 0.8 * pages) & (F.col("chars_per_page") < 200)
    scanned = is_pdf & (dominated | ((pages > 0) & (F.col("scanned_pages") == pages)))
    rows = rows.withColumn("is_scanned", F.coalesce(scanned, F.lit(False)))
    rows = rows.withColumn("is_mixed_scan", is_pdf & ~F.col("is_scanned") & (F.col("scanned_pages") > 0) & (F.col("native_pages") > 0))
    lost = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    kind = F.when(F.col("is_scanned") | (F.col("chars_per_page") < 100), "image_heavy").when(F.col("chars_per_page") > 500, "text_heavy").when(F.col("text_size_ratio") < 0.05, "image_heavy").otherwise("mixed")
    quality = F.when(F.col("text_length") == 0, "").when(lost > 0.1 * F.col("text_length"), "degraded").otherwise("good")
    ok = F.col("error").isNull()
    return rows.withColumns({"classification": F.when(ok, kind).otherwise(""), "extraction_quality": F.when(ok, F.coalesce(quality, F.lit(""))).otherwise("")})


def extraction_summary(classified: DataFrame) -> DataFrame:
    """One row of counters; files with an error are only counted as such."""
    ok, is_pdf = F.col("error").isNull(), F.col("mime") == "application/pdf"
    filled = lambda c: F.count_if(ok & F.col("mime").isin(*EXTRACTABLE) & (F.coalesce(c, F.lit("")) != ""))
    return classified.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(~ok).alias("n_errors"), F.count_if(ok & is_pdf & F.col("is_scanned")).alias("n_scanned"),
        F.count_if(ok & is_pdf & F.col("is_mixed_scan")).alias("n_mixed_scan"), F.count_if(ok & is_pdf & ~F.col("is_scanned") & ~F.col("is_mixed_scan")).alias("n_native"),
        F.count_if(F.col("classification") == "text_heavy").alias("n_text_heavy"), F.count_if(F.col("classification") == "image_heavy").alias("n_image_heavy"),
        F.count_if(F.col("classification") == "mixed").alias("n_mixed"), F.count_if(F.col("extraction_quality") == "degraded").alias("n_degraded"),
        filled("title").alias("n_title"), filled("author").alias("n_author"), filled("creation_date").alias("n_creation_date"),
        F.min(F.when(ok & (F.col("page_count") > 0), F.col("page_count"))).alias("min_pages"), F.max(F.when(ok & (F.col("page_count") > 0), F.col("page_count"))).alias("max_pages"),
        F.round(F.avg(F.when(ok & (F.col("page_count") > 0), F.col("page_count"))), 2).alias("avg_pages"),
    )
