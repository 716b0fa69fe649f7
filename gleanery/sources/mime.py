"""MIME types by extension, else by first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.paths import extension
from gleanery.operators.health import begins

# Types by extension.
BY_EXTENSION = {
    ".txt": "text/plain", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "text/json", ".jsonl": "text/json", ".xml": "text/xml", ".html": "text/html",
    ".htm": "text/html", ".md": "text/markdown", ".rst": "text/x-rst", ".yaml": "text/yaml", ".yml": "text/yaml", ".toml": "text/toml", ".ini": "text/plain",
    ".cfg": "text/plain", ".conf": "text/plain", ".log": "text/plain", ".eml": "message/rfc822", ".epub": "application/epub+zip", ".py": "text/x-python",
    ".js": "text/javascript", ".ts": "text/typescript", ".css": "text/css", ".sql": "text/x-sql", ".sh": "text/x-shellscript", ".bat": "text/x-bat",
    ".ps1": "text/x-powershell", ".r": "text/x-r", ".rb": "text/x-ruby", ".java": "text/x-java", ".c": "text/x-c", ".cpp": "text/x-c++", ".h": "text/x-c",
    ".go": "text/x-go", ".rs": "text/x-rust", ".parquet": "application/vnd.apache.parquet", ".avro": "application/avro", ".arrow": "application/vnd.apache.arrow.file",
    ".feather": "application/vnd.apache.arrow.file", ".orc": "application/x-orc", ".ndjson": "text/json",
}
_OFFICE = "application/vnd.openxmlformats-officedocument."
BY_ZIP_EXTENSION = {".docx": _OFFICE + "wordprocessingml.document", ".xlsx": _OFFICE + "spreadsheetml.sheet", ".pptx": _OFFICE + "presentationml.presentation"}
BY_FIRST_BYTES = [
    (b"%PDF", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"),
    (b"PK\x03\x04", "application/zip"), (b"PK\x05\x06", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
    (b"Rar!\x1a\x07", "application/vnd.rar"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"\x7fELF", "application/x-executable"), (b"PAR1", "application/vnd.apache.parquet"),
    (b"ID3", "audio/mpeg"), (b"BM", "image/bmp"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/x-flac"), (b"BZh", "application/x-bzip2"), (b"\xfd7zXZ\x00", "application/x-xz"), (b"{\\rtf", "application/rtf"),
]
UNKNOWN = "application/octet-stream"


def by_extension(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return known[extension(path)]


def by_content(path: Column, content: Column) -> Column:
    first = F.substring(content, 1, 16)
    ext = extension(path)
    out = None
    for e, kind in BY_ZIP_EXTENSION.items():
        test = begins(first, b"PK\x03\x04") & (ext == e)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    for value, kind in BY_FIRST_BYTES:
        out = out.when(begins(first, value), kind)
    out = out.when(begins(first, b"RIFF") & (F.substring(content, 9, 4) == F.unhex(F.lit(b"WEBP".hex()))), "image/webp")
    return out.otherwise(F.lit(None))


def mime_of(path: Column, content: Column) -> Column:
    """The extension decides where it is known; content is looked at only where it is not."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv]), extension(path)), by_content(path, content), F.lit(UNKNOWN))
