"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; every record is a frame of its own, so records can
be read alone.  Archives are rows (archive, content) of a table in a folder that all executors share, or files: those
that write_files() makes, and any others, of every record type of WARC 1.0 and 1.1.  An archive closes at ARCHIVE_BYTES
of payload.

A record's block is an HTTP response.  Of pages with equal payloads of at least `least` bytes, that with the largest id
is a response record and the others are revisits: they carry the HTTP head alone, the digest and length of the full
payload, and name the response they refer to.  Smaller payloads are responses all.  Only digests that stand more than
once are joined back to the pages.

Reading goes on from whatever cannot be read: a frame that is damaged, cut or larger than RECORD_BYTES, a record whose
headers, lengths or digests are wrong, becomes a row with its offset and an error, and the next frame that can be read
is sought.

Cases: a null payload counts as empty, a null URL is left out; long payloads are records as any others; rows of the
largest id that repeat are responses all, and null ids count as smaller than any other; repeated rows have a record
each; an empty table gives no archive, and no archive gives no records; columns other than page_id, url and html are
never read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, EMPTY_DIGEST_BYTES = "urn:x-page:", 20
#: Payload of an archive; payloads that a dictionary is trained on, bytes taken of each, and its size.
ARCHIVE_BYTES, TRAINED_ON, TRAINED_BYTES, DICTIONARY_BYTES = 8_000_000, 150, 8_000, 16_384
LEVEL = 3
#: Largest record, as it is and compressed, and largest dictionary, that reading takes into memory; bytes read at a time;
#: files up to this size come whole from Spark's reader, larger ones are streamed.
RECORD_BYTES, SHARED_BYTES, READ_BYTES, WHOLE_BYTES = 1 << 30, 1 << 27, 1 << 20, 1 << 28

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def frame_length(data, at: int) -> int:
    """Bytes of the Zstandard frame at an offset, from its headers alone."""
    if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        if pos + 3 > len(data):
            raise ValueError("cut frame")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * checksum
    if pos > len(data):
        raise ValueError("cut frame")
    return pos - at


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str) -> str:
    """A header's value in one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def format_record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<{ID_PREFIX}{'' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def unchunked(payload: bytes) -> bytes:
    """What the chunks of a payload hold."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(payload, at):
        at = m.end() + int(m[1], 16)
        out.append(payload[m.end() : at])
        at += 2
    return b"".join(out)


def parse_record(data: bytes) -> dict:
    """The record's fields; raises ValueError if a header or a length is wrong.

    HTTP responses and revisits must have an HTTP head, with a length or without; the payload of other records is their block.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9!#$%&'*+.^_`|~-]+", k):
            raise ValueError(f"bad header line {line[:40]!r}")
        if k.lower() in fields and k.lower() in ("warc-type", "warc-record-id", "warc-date", "content-length", "content-type"):
            raise ValueError(f"two headers {k.lower()}")
        fields[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"no {k}")
    if not fields["content-length"].isdecimal() or int(fields["content-length"]) + 4 != len(rest):
        raise ValueError("Content-Length differs from the block's length")
    if rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record does not end in two line ends")
    block = rest[:-4]
    if (d := fields.get("warc-block-digest")) and d != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    kind, given = fields["warc-type"], fields.get("warc-payload-digest")
    digest = given.removeprefix("sha1:") if given else None
    payload, size = block, len(block)
    if kind in ("response", "revisit") and fields.get("content-type", "").lower().startswith("application/http") and (block or kind == "response"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        lengths = re.findall(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        if len(set(lengths)) > 1:
            raise ValueError("two lengths in the HTTP head")
        chunked = re.search(rb"(?im)^transfer-encoding:.*chunked", http)
        size = int(lengths[0]) if lengths and not chunked else len(payload) if kind == "response" else None
        # writers differ in whether a chunked payload's digest is that of its chunks or of what these hold
        told = digest in (None, base32_sha1(payload)) or chunked and digest == base32_sha1(unchunked(payload))
        if kind == "response" and (size != len(payload) or not told):
            raise ValueError("payload's length or digest differs")
    elif kind == "revisit":
        size = None
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit has a payload or refers to nothing")

    def page(name: str) -> int | None:
        m = re.fullmatch(rf"<{ID_PREFIX}(-?\d*)>", fields.get(name, ""))
        return int(m[1]) if m and m[1] else None

    return {
        "record_type": kind, "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size,
        "refers_to": page("warc-refers-to") if kind == "revisit" else None, "payload": None if kind == "revisit" else payload,
    }


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, then a frame for each record."""
    import zstandard as zstd

    samples = [r[:TRAINED_BYTES] for r in records[:: max(1, len(records) // TRAINED_ON)]]
    try:
        raw = zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little to train on: its beginning serves as content
        raw = b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" ")
    coder = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(coder.compress, records)])


class _Reader:
    """A window that moves over an archive's bytes; what has been read is let go of when more is."""

    def __init__(self, source):
        self.source = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        self.data, self.at, self.start, self.ended = b"", 0, 0, False  # data[at] is the archive's byte `start`

    def more(self) -> bool:
        """Reads on, as much again as is held."""
        got = b"" if self.ended else self.source.read(max(READ_BYTES, len(self.data) - self.at))
        self.ended = not got
        if got:
            self.data, self.at = self.data[self.at :] + got, 0
        return not self.ended

    def held(self) -> int:
        return len(self.data) - self.at

    def has(self, n: int) -> bool:
        while self.held() < n and self.more():
            pass
        return self.held() >= n

    def word(self, at: int = 0) -> int:
        """Four bytes as a number."""
        return struct.unpack_from("<I", self.data, self.at + at)[0]

    def part(self, n: int, at: int = 0) -> bytes:
        return self.data[self.at + at : self.at + at + n]

    def skip(self, n: int) -> None:
        """Moves on, past the end at most; what is skipped is never held at once."""
        while n > self.held():
            n, self.start, self.at = n - self.held(), self.start + self.held(), len(self.data)
            if not self.more():
                return
        self.at, self.start = self.at + n, self.start + n


def _inflated(coder, frame, most: int) -> bytes:
    """A frame's content; ValueError if it is damaged or larger than the bound, which is checked before memory is taken."""
    import zstandard as zstd

    try:
        size = zstd.frame_content_size(frame)
        if size > most:
            raise ValueError("larger than the bound")
        if size >= 0:
            return coder.decompress(frame)
        parts, held = [], 0
        with coder.stream_reader(frame) as f:
            while part := f.read(READ_BYTES):
                parts.append(part)
                held += len(part)
                if held > most:
                    raise ValueError("larger than the bound")
        return b"".join(parts)
    except (zstd.ZstdError, MemoryError) as e:
        raise ValueError(f"frame: {e}") from None


def unpack(source, most: int = RECORD_BYTES):
    """(offset, record as bytes, error) of every frame of an archive, given as bytes or as a file to read from.

    After a frame that cannot be read the next one is sought: where the bad one ends by its headers, if a frame begins
    there, else wherever a frame begins that can be read and holds a record.
    """
    import zstandard as zstd

    r = _Reader(source)
    shared, magic = None, struct.pack("<I", FRAME_MAGIC)
    if r.has(8) and r.word() == DICTIONARY_MAGIC:
        size = r.word(4)
        if size > SHARED_BYTES or not r.has(8 + size):
            yield 0, b"", "cut dictionary" if size <= SHARED_BYTES else "dictionary larger than the bound"
            return
        raw = r.part(size, 8)
        try:
            if raw.startswith(magic):  # the dictionary itself may be compressed
                raw = _inflated(zstd.ZstdDecompressor(), raw, SHARED_BYTES)
            shared = zstd.ZstdCompressionDict(raw)
        except ValueError as e:
            yield 0, b"", f"dictionary: {e}"
            return
        r.skip(8 + size)
    coder = zstd.ZstdDecompressor(dict_data=shared) if shared else zstd.ZstdDecompressor()

    def measured() -> int:
        """Length of the frame that the window begins with."""
        while True:
            try:
                return frame_length(r.data, r.at)
            except ValueError as e:
                if str(e) != "cut frame" and r.held() >= 6 or r.held() > most or not r.more():
                    raise

    def skippable(at: int = 0) -> bool:
        return 0x184D2A50 <= r.word(at) <= 0x184D2A5F

    def begins(at: int) -> bool:
        return not r.has(at + 1) or r.has(at + 4) and (r.word(at) == FRAME_MAGIC or skippable(at))

    while r.has(1):
        if r.has(8) and skippable():
            r.skip(8 + r.word(4))
            continue
        size = 0
        try:
            size = measured()
            record = _inflated(coder, r.part(size), most)
        except ValueError as e:
            yield r.start, b"", str(e)
        else:
            yield r.start, record, None
            r.skip(size)
            continue
        if size and begins(size):
            r.skip(size)
            continue
        r.skip(1)
        while True:
            at = r.data.find(magic, r.at)
            if at < 0:
                r.skip(max(0, r.held() - 3))
                if not r.more():
                    return
                continue
            r.skip(at - r.at)
            try:
                if _inflated(coder, r.part(measured()), most).startswith(b"WARC/"):
                    break
            except ValueError:
                pass
            r.skip(1)


def _info(name: str, date: str) -> bytes:
    """The record that an archive's file begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <{ID_PREFIX}archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least: int = 0, scratch: Scratch | None = None, info: bool = False) -> DataFrame:
    """archive and content: rows of whole archives, each with a warcinfo record if asked for.  pages: page_id, url, html."""
    scratch = scratch or Scratch(pages.sparkSession)
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.unhex(F.sha1(body)).alias("digest"))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    # a narrow table: the payloads are shuffled only if it is too large to be broadcast
    joined = rows.join(scratch.keep(repeated.select("digest", "keeper"), "repeated"), "digest", "left")
    big = F.octet_length("payload") >= least
    refers = F.when(big & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    joined = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"part-{part:05d}-{made:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack([_info(name, date)] * info + held)], pa.binary())], ["archive", "content"])

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                kind = "response" if refers_to is None else "revisit"
                held.append(format_record(kind, page_id, url, base64.b32encode(digest).decode(), len(payload), payload if kind == "response" else b"", refers_to, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    return joined.mapInArrow(run, "archive string, content binary")


def _records(name: str, source):
    """Batches of the records (RECORD) of one archive."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, rows, size = to_arrow_schema(RECORD), [], 0
    for at, data, error in unpack(source):
        row = {"archive": name, "offset": at, "error": error}
        if error is None:
            try:
                row |= parse_record(data)
            except ValueError as e:
                row["error"] = str(e)
        rows.append(row)
        size += len(data)
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read(files: DataFrame) -> DataFrame:
    """The records (RECORD) of archives; a record that is not valid has an error, and its fields are null."""

    def run(batches):
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns)):
                yield from _records(name, content or b"")

    return files.select("archive", "content").mapInArrow(run, RECORD)


def _opened(uri: str):
    """A store of files that executors reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def read_streams(paths: DataFrame) -> DataFrame:
    """The records of archives of any size, read as streams.  paths: archive, a URI of a store that executors reach."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            for uri in b.column(0).to_pylist():
                try:
                    store, path = _opened(uri)
                    with store.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as f:
                        yield from _records(uri, f)
                except (OSError, pa.ArrowInvalid) as e:
                    yield pa.RecordBatch.from_pylist([{"archive": uri, "error": f"cannot be opened: {type(e).__name__}"}], to_arrow_schema(RECORD))

    return paths.select("archive").mapInArrow(run, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.zst files under a path; files above WHOLE_BYTES are streamed, not held."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    whole = files.where(F.col("length") <= WHOLE_BYTES).select(F.col("path").alias("archive"), "content")
    return read(whole).unionByName(read_streams(files.where(F.col("length") > WHOLE_BYTES).select(F.col("path").alias("archive"))))


def write_files(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes the pages' archives as .warc.zst files into a folder (a URI that executors reach), and returns a row for each:
    archive, bytes.  A task that runs again writes the same names; a file appears under its name when it is complete."""
    scratch = scratch or Scratch(pages.sparkSession)
    uri = path if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{path}"

    def run(batches):
        import uuid

        import pyarrow as pa

        store, folder = _opened(uri)
        store.create_dir(folder, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, content in zip(names, b.column(1).to_pylist()):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(content)
                store.move(part, f"{folder}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array([f"{uri.rstrip('/')}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64())], ["archive", "bytes"])

    made = archives(pages, date, least, scratch, info=True).mapInArrow(run, "archive string, bytes long")
    return scratch.keep(made, "files")


def round_trip(pages: DataFrame, least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes the pages to archives in the shared folder, and reads them back; a record that is not valid fails the job."""
    scratch = scratch or Scratch(pages.sparkSession)
    records = read(scratch.keep(archives(pages, least=least, scratch=scratch), "archives"))
    return records.where(F.col("error").isNull() | F.raise_error(F.concat(F.lit("WARC record: "), "archive", F.lit(" "), "error")).isNull())
