"""What a file is: by its name, then by its first bytes and its text."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions and what they hold; code extensions and their languages; size limits.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "csv": "csv", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml",
    "html": "html", "htm": "html", "md": "markdown", "txt": "text", "rst": "text", "log": "log", "eml": "email", "vtt": "transcript", "srt": "transcript",
    "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "wav": "audio", "mp3": "audio", "mp4": "video", "webm": "video",
}
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "java": "java", "go": "go", "rs": "rust",
    "c": "c", "cpp": "cpp", "h": "c", "cs": "csharp", "sh": "bash", "sql": "sql", "rb": "ruby", "php": "php",
}
MOST_BYTES = 50 << 20
MOST_ARCHIVE_BYTES = 100 << 20
MOST_ENTRIES = 2000

TEXTUAL = {"csv", "json", "xml", "yaml", "html", "markdown", "text", "log", "email", "transcript", "code"}


class Unreadable(ValueError):
    """A file that is refused, with the reason."""


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def by_name(path: Column) -> Column:
    """The modality that a path's extension names; null where none does."""
    pairs = [x for k, v in (EXTENSIONS | dict.fromkeys(LANGUAGES, "code")).items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[extension(path)]


def archive(data: bytes) -> set[str]:
    """The entries of an Office archive, which must be small and open."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = z.infolist()
        if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_ARCHIVE_BYTES:
            raise Unreadable("archive is too large")
        if any(e.flag_bits & 1 for e in entries):
            raise Unreadable("archive is encrypted")
        return {e.filename for e in entries}


def inspect(name: str, data: bytes) -> tuple[str, str]:
    """(modality, text) of a file; refuses what is empty, too large, or not what its name says."""
    if not data or len(data) > MOST_BYTES:
        raise Unreadable("file is empty or too large")
    end = name.rpartition(".")[2].lower()
    kind = "code" if end in LANGUAGES else EXTENSIONS.get(end)
    if kind is None:
        raise Unreadable(f"unknown extension {end!r}")
    if kind in ("docx", "pptx", "xlsx"):
        want = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}[kind]
        try:
            found = archive(data)
        except zipfile.BadZipFile as e:
            raise Unreadable("not an Office archive") from e
        if want not in found:
            raise Unreadable(f"{want} is missing")
        return kind, ""
    if kind not in TEXTUAL:
        magic = {"pdf": (b"%PDF-",), "image": (b"\x89PNG", b"\xff\xd8\xff", b"II*\0", b"MM\0*")}.get(kind)
        if magic and not data.startswith(magic):
            raise Unreadable(f"content isn't {kind}")
        return kind, ""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise Unreadable("text isn't UTF-8") from e
    if "\0" in text or not text.strip():
        raise Unreadable("text is blank or holds NUL")
    if kind == "text":
        kind = sniff(text)
    if kind == "csv" and len(next(csv.reader(io.StringIO(text)), [])) < 2:
        raise Unreadable("CSV needs two columns")
    if kind == "email" and not re.match(r"(?:[!-9;-~]+:.*\r?\n(?:[ \t].*\r?\n)*)+\r?\n", text):
        raise Unreadable("no mail header")
    return kind, text


def sniff(text: str) -> str:
    """Plain text that is really HTML, JSON or Markdown."""
    head = text.lstrip()[:200].lower()
    if head.startswith(("<!doctype html", "<html")):
        return "html"
    if head[:1] in "{[":
        try:
            json.loads(text)
            return "json"
        except ValueError:
            pass
    if re.search(r"(?m)^#{1,6} \S|^```|^\|.+\|\s*\n\|[ :|-]+\|", text):
        return "markdown"
    return "text"
