"""Uploaded files to texts: type detection, extraction, archives.

The input is what Spark's binaryFile source gives: path (or filename) and content.  Errors are columns, not exceptions:
one bad file never stops the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PDF, DOCX, RTF, TXT = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/rtf", "text/plain"
EXTENSIONS = {"pdf": PDF, "docx": DOCX, "rtf": RTF, "txt": TXT}
#: Caps of an upload.
FILE_BYTES, DOCX_BYTES, ENTRY_BYTES, ARCHIVE_BYTES, ENTRIES, PAGES, SPARSE = 10 << 20, 50 << 20, 10 << 20, 100 << 20, 50, 300, 200
SPARSE_WARNING = "low_text_density_consider_ocr"
RESUME_EXTENSIONS, JOB_EXTENSIONS = ("pdf", "docx", "rtf", "txt"), ("pdf", "docx", "txt", "json")
#: Keys of a job description in JSON, in order of preference.
JSON_TEXT_KEYS = ("description", "job_description", "jd", "text", "body", "content", "summary")

PAGE_SCHEMA = "path string, page_no int, text string, warning string, error string"
ENTRY_SCHEMA = "path string, at int, entry string, content binary, error string"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def detect_mime(content: Column) -> Column:
    """By the first bytes; whatever is none of the known kinds is text."""
    head = F.hex(F.substring(content, 1, 64))
    trimmed = F.regexp_replace(head, r"^(?:(?:20|09|0A|0B|0C|0D))+", "")
    return F.when(head.startswith("25504446"), PDF).when(head.startswith("504B0304"), DOCX).when(trimmed.startswith("7B5C727466"), RTF).otherwise(TXT)


def mime_agrees(name: Column, content: Column) -> Column:
    """Whether the extension is known and names the kind that the bytes show."""
    expected = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[extension(name)]
    return F.coalesce(expected == detect_mime(content), F.lit(False))


def decode(data: bytes) -> str:
    for codec in ("utf-8-sig", "utf-8"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def docx_text(data: bytes) -> str:
    """Paragraphs, one a line.  What is read is counted, whatever size the archive declares."""
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
        raw = f.read(DOCX_BYTES + 1)
    if len(raw) > DOCX_BYTES:
        raise ValueError("decompresses past the cap")
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("declares entities")
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = []
    for p in ElementTree.fromstring(raw).iter(f"{w}p"):
        lines.append("".join(x.text or "" if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag in (f"{w}br", f"{w}cr") else "" for x in p.iter()))
    return "\n".join(lines)


def rtf_text(data: bytes) -> str:
    """Text of a document's visible groups."""
    src, out, skip, stack, i = data.decode("latin-1"), [], False, [], 0
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "themedata", "datastore", "generator"}
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
    drop = 0
    while i < len(src) and (m := token.match(src, i)):
        i = m.end()
        word, number, byte, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word in hidden:
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            drop = 1
        elif byte:
            if drop:
                drop = 0
            else:
                out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
        elif symbol and symbol in "\\{}":
            out.append(symbol)
        elif plain:
            out.append(plain[drop:])
            drop = 0
    return "".join(out).strip()


def pdf_pages(data: bytes) -> list[str]:
    """Text blocks of each page from top to bottom, if a reader for the format is installed."""
    try:
        import fitz
    except ImportError:
        raise ValueError("no PDF reader is installed") from None
    with fitz.open(stream=data, filetype="pdf") as doc:
        if doc.needs_pass:
            raise ValueError("encrypted")
        if doc.page_count > PAGES:
            raise ValueError("too many pages")
        return ["\n".join(b[4].strip() for b in sorted((b for b in p.get_text("blocks") if b[6] == 0), key=lambda b: (b[1], b[0]))) for p in doc]


def extract(data: bytes, mime: str) -> tuple[list[str], str | None]:
    """Pages without NULs, and a warning for documents with hardly any text."""
    if len(data) > FILE_BYTES:
        raise ValueError("too large")
    if mime == PDF:
        pages = pdf_pages(data)
    elif mime == DOCX:
        pages = [docx_text(data)]
    elif mime == RTF:
        pages = [rtf_text(data)]
    elif mime == TXT:
        pages = [decode(data)]
    else:
        raise ValueError(f"unsupported type {mime}")
    pages = [p.replace("\x00", "") for p in pages]
    sparse = mime in (PDF, RTF) and sum(map(len, pages)) < SPARSE
    return pages, SPARSE_WARNING if sparse else None


def pages(files: DataFrame) -> DataFrame:
    """path, page_no, text, warning, error: a row a page; a file that cannot be read has one row with its error."""
    typed = files.select("path", "content", detect_mime(F.col("content")).alias("mime"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, content, mime in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found, warning = extract(content or b"", mime)
                    rows += [(path, i + 1, t, warning, None) for i, t in enumerate(found)]
                except Exception as e:  # the file's fault, kept as its error
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["path", "page_no", "text", "warning", "error"])

    return typed.mapInArrow(run, PAGE_SCHEMA)


def entry_fault(name: str, allowed: tuple[str, ...]) -> str | None:
    plain = name.replace("\\", "/")
    if not name or plain.startswith("/") or re.match(r"^[A-Za-z]:", plain):
        return "entry name is empty or absolute"
    if ".." in plain.split("/"):
        return "entry name climbs"
    return None if name.rpartition(".")[2].lower() in allowed and "." in name else "extension is not allowed"


def expand_archive(data: bytes, allowed: tuple[str, ...] = RESUME_EXTENSIONS) -> list[tuple[str, bytes]]:
    """All entries, or ValueError: names are checked before any is read, and sizes as they are read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > ENTRIES:
                raise ValueError("too many entries")
            for i in infos:
                if fault := entry_fault(i.filename, allowed):
                    raise ValueError(fault)
            out, total = [], 0
            for i in infos:
                i.file_size = 1 << 40  # what the archive declares is not trusted
                with z.open(i) as f:
                    content = f.read(ENTRY_BYTES + 1)
                total += len(content)
                if len(content) > ENTRY_BYTES or total > ARCHIVE_BYTES:
                    raise ValueError("decompresses past the cap")
                out.append((i.filename, content))
            return out
    except (zipfile.BadZipFile, EOFError) as e:
        raise ValueError(f"no valid archive: {e}") from None


def archive_entries(files: DataFrame, allowed: tuple[str, ...] = RESUME_EXTENSIONS) -> DataFrame:
    """path, at, entry, content, error: a row an entry in archive order; a bad entry rejects its whole archive."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = [(path, i, n, c, None) for i, (n, c) in enumerate(expand_archive(content or b"", allowed))]
                except (ValueError, RuntimeError, NotImplementedError) as e:
                    rows = [(path, None, None, None, str(e)[:200])]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "at", "entry", "content", "error"])

    return files.select("path", "content").mapInArrow(run, ENTRY_SCHEMA)


def job_text(raw: Column) -> Column:
    """Text of a job description in JSON: the first known key that is not blank, else the document as it stands."""
    found = [F.get_json_object(raw, f"$.{k}") for k in JSON_TEXT_KEYS]
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in found], raw)
