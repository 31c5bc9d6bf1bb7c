"""WARC derivatives: linked metadata and plain-text conversion records for responses."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.batch import worker_cache

VERSION = "WARC/1.1"
#: The date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Ids are name-based in this space, so that a task that runs twice makes the same records.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodeframe:warc")
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_RAW = frozenset("script style template noscript iframe textarea".split())
_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>?)")
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_CLOSE = {name: re.compile(f"</{name}", re.I) for name in _RAW}
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")
#: Bytes of compressed input that are read at a time.
_STEP = 1 << 20
_GAPS = re.compile(r"[ \t\r\f\v\xa0]*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(map(str, parts)))}>"


def build(headers: list[tuple[str, str | None]], block: bytes, version: str = VERSION) -> bytes:
    """A record: headers without null values and without line breaks in them, Content-Length, the block."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in headers if v is not None]
    head = "\r\n".join([version, *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of ``data``, one in memory at a time; ``data`` itself if it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        d = zlib.decompressobj(31)
        out = [d.decompress(rest[:_STEP])]
        at = _STEP
        while not d.eof and at < len(rest):
            out.append(d.decompress(rest[at : at + _STEP]))
            at += _STEP
        if not d.eof:
            raise ValueError("a gzip member is cut off")
        yield b"".join(out)
        rest = rest[min(at, len(rest)) - len(d.unused_data) :]


class Damaged(ValueError):
    """What stands where a record should, or the reason that the rest of a file cannot be read."""


def records(data: bytes) -> Iterator[tuple[str, list[tuple[str, str]], bytes]]:
    """(version, [(header, value)] in their order, block) of each record in ``data``, plain or of gzip members.

    Raises Damaged at the first place that is no whole record: a length that is missing, wrong or beyond the end, or a
    member that cannot be unpacked.
    """
    each = members(data)
    while True:
        try:
            part = next(each)
        except StopIteration:
            return
        except (ValueError, zlib.error) as e:
            raise Damaged(str(e)) from e
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if end < 0 or not part.startswith(b"WARC/", at):
                raise Damaged(f"no WARC record at byte {at}")
            version, *lines = part[at:end].decode("utf-8", "replace").split("\r\n")
            headers = _headers(lines)
            size = named(headers).get("content-length", "")
            if not size.isdecimal() or end + 4 + int(size) > len(part):
                raise Damaged(f"a record at byte {at} with the length {size or 'missing'}")
            yield version, headers, part[end + 4 : end + 4 + int(size)]
            at = end + 4 + int(size) + 4


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The headers and the block of each record, see ``records``."""
    for _, headers, block in records(data):
        yield headers, block


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {x.strip()}"
        else:
            k, _, v = x.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def named(headers: list[tuple[str, str]]) -> dict[str, str]:
    """The first value of each header, by lower-cased name."""
    return {k.lower(): v for k, v in reversed(headers)}


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, all headers in their order, body as it was sent) of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], _headers(lines[1:]), body


def decoded(body: bytes, headers: dict[str, str]) -> bytes:
    """The body without chunks and without compression by gzip or deflate; what cannot be decoded stays as it is."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, at = [], 0
        while m := _CHUNK.match(body, at):
            size = int(m[1], 16)
            out.append(body[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        body = b"".join(out) if out else body
    for coding in reversed(headers.get("content-encoding", "").lower().split(",")):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding.strip(), ()):
            try:
                body = _inflated(body, bits)
                break
            except zlib.error:
                continue
    return body


#: Bytes that a body may unpack to; what goes on beyond is taken for a trap, and the body stays as it was sent.
MOST_UNPACKED = 256 << 20


def _inflated(body: bytes, bits: int) -> bytes:
    """All members of a compressed body; what stands behind the last is left out, a last one that is cut off is not."""
    out, size, rest = [], 0, body
    while rest and (not out or bits == 31 and rest[:2] == b"\x1f\x8b"):
        d = zlib.decompressobj(bits)
        try:
            out.append(d.decompress(rest, MOST_UNPACKED + 1 - size))
        except zlib.error:
            if not out:
                raise
            break
        size += len(out[-1])
        if size > MOST_UNPACKED:
            raise zlib.error("unpacks to too much")
        rest = d.unused_data
    return b"".join(out)


#: Content types that have a plain text; a response without type is taken for a page.
_TEXT = re.compile(r"text/|application/(xhtml\+xml|xml|json|[\w.-]+\+xml)", re.I)
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9._-]+)", re.I)


def _letters(body: bytes, kind: str) -> str:
    """A body as text: by its byte order mark, the charset of its header or of its markup, UTF-8, or else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    said = re.search(r"charset=[\"']?([\w.-]+)", kind, re.I)
    meta = _META.search(body[:4096])
    for name in (said and said[1], meta and meta[1].decode("ascii")):
        if name:
            try:
                return body.decode("cp1252" if name.lower() in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii") else name, "replace")
            except LookupError:
                continue
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def extract(page: str) -> tuple[str, str, list[str]]:
    """(title, plain text, link targets) of an HTML page, in one pass over its tags.

    Comments, declarations, scripts, styles and what a browser would not show are left out; an element of ``_BLOCKS``
    begins a new line; entities are resolved; runs of white space become one space, blank lines go. An unclosed script
    or comment runs to the end of the page.
    """
    out: list[str] = []
    title: list[str] = []
    links: list[str] = []
    at, in_title = 0, False
    while m := _TAG.search(page, at):
        (title if in_title else out).append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            close = "-->" if m[0] == "<!--" else ">"
            end = page.find(close, at)
            at = len(page) if end < 0 else end + len(close)
            continue
        name = m[2].lower()
        if name == "title":
            in_title = not m[1]
        elif name in _RAW and not m[1]:
            end = _CLOSE[name].search(page, at)
            at = end.start() if end else len(page)
        elif name == "a" and not m[1] and (h := _HREF.search(m[0])):
            links.append(html.unescape(h[1] or h[2] or h[3] or ""))
        if name in _BLOCKS:
            out.append("\n")
    (title if in_title else out).append(page[at:])
    clean = lambda x: _GAPS.sub("\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", html.unescape("".join(x)))).strip()
    lines = (x.strip() for x in clean(out).split("\n"))
    return " ".join(clean(title).split()), "\n".join(x for x in lines if x), links


def derive(given: list[tuple[str, str]], block: bytes, version: str = VERSION) -> list[dict]:
    """The metadata and the conversion record of one response, given its WARC headers, its block and its version.

    A body that is no text has no conversion record; the metadata record says so.

    Both refer to the response by its id and carry its target and date. The metadata record lists the source's status
    line, all its HTTP headers in their order, repeated ones each, its digests, the page's title and its links; the
    conversion record holds the plain text, its own digests, and the metadata record's id as concurrent.
    """
    source = named(given)
    rid, uri, date = source.get("warc-record-id"), source.get("warc-target-uri"), source.get("warc-date", NO_DATE)
    status, sent, raw = http_parts(block)
    http = named(sent)
    body = decoded(raw, http)
    kind = http.get("content-type", "")
    readable = not kind.strip() or _TEXT.match(kind.strip()) is not None
    page = _letters(body, kind) if readable else ""
    title, text, links = extract(page)
    payload = source.get("warc-payload-digest") or digest(raw)
    fields = [
        ("source-status", status),
        *((f"source-header-{k.lower()}", v) for k, v in sent),
        ("source-content-length", str(len(block))),
        ("source-block-digest", source.get("warc-block-digest") or digest(block)),
        ("source-payload-digest", payload),
        ("title", title or None), ("conversion", None if readable else f"none, for {kind} is no text"),
        *(("outlink", x) for x in links),
    ]
    meta_block = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None).encode()
    meta_id, conv_id = record_id("metadata", rid), record_id("conversion", rid)
    out = []
    for what, own, other, mime, content in (
        ("metadata", meta_id, None, "application/warc-fields", meta_block),
        ("conversion", conv_id, meta_id, "text/plain; charset=utf-8", text.encode()),
    ):
        if what == "conversion" and not readable:
            continue
        own_digest = digest(content)
        headers = [
            ("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", rid), ("WARC-Concurrent-To", other), ("WARC-Block-Digest", own_digest),
            ("WARC-Source-Payload-Digest", payload), ("Content-Type", mime),
        ]
        out.append({
            "record_type": what, "record_id": own, "refers_to": rid, "target_uri": uri, "warc_date": date,
            "block_digest": own_digest, "source_payload_digest": payload, "content_length": len(content),
            "record": build(headers, content, version),
        })
    return out


DERIVED = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "block_digest string, source_payload_digest string, content_length long, record binary"
)


def response(page_id: object, url: str | None, page: str | None) -> bytes:
    """The response record of a row of ``pages``; null pages have an empty body, null URLs no target."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(body))), ("WARC-Date", NO_DATE),
        ("WARC-Target-URI", url), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return build(headers, block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, damage) of every record in the WARC files at ``path``, plain or gzip.

    Where a file cannot be read on, one row has a null record and says why, so that damage is counted and stops nothing;
    the records before it stay, and so do repeated ones. An empty file has no rows. Records keep their WARC version.

    A file is one task's work: it is held as it is stored (Spark's limit for a value is 2 GB), its gzip members are
    opened one after the other, and its records leave one by one.
    """
    import pyarrow as pa

    names = ["path", "record", "damage"]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    for version, headers, block in records(content.as_py()):
                        whole = build([(k, v) for k, v in headers if k.lower() != "content-length"], block, version)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([whole], pa.binary()), pa.nulls(1, pa.string())], names=names)
                except Damaged as e:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.binary()), pa.array([str(e)])], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record binary, damage string")


def derivatives(rows: DataFrame, *keep: str, record: str = "record") -> DataFrame:
    """Two rows, metadata and conversion, for every response in the column ``record``; other record types give none.

    The columns ``keep`` come first. Null records give no rows, and neither does what stands behind damage in a record;
    a body that is no text has a metadata row only; repeated responses give repeated records; an empty
    table gives an empty result. No shuffle, one record in memory at a time and task.
    """
    return _run(rows.select(*keep, record), keep, lambda cells: cells[-1])


def page_derivatives(pages: DataFrame, *keep: str) -> DataFrame:
    """``derivatives`` of the responses made from ``page_id``, ``url`` and ``html``."""
    cols = [F.col(c).alias(f"__{c}") for c in ("page_id", "url", "html")]
    return _run(pages.select(*keep, *cols), keep, lambda cells: response(*cells[-3:]))


def _run(rows: DataFrame, keep: tuple[str, ...], source) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql import types as T

    made = rows.sparkSession.createDataFrame([], DERIVED).schema
    schema = T.StructType([rows.schema[k] for k in keep] + list(made))

    def run(batches):
        worker_cache(None)
        for b in batches:
            held: list[dict] = []
            back: list[int] = []
            size = 0

            def out():
                own = [b.column(i).take(pa.array(back, pa.int64())) for i in range(len(keep))]
                types = [pa.string()] * 7 + [pa.int64(), pa.binary()]
                cols = [pa.array([h[n] for h in held], t) for n, t in zip(made.names, types)]
                return pa.RecordBatch.from_arrays([*own, *cols], names=schema.names)

            for i in range(b.num_rows):
                raw = source([c[i].as_py() for c in b.columns])
                with contextlib.suppress(Damaged):
                    for version, headers, block in records(raw) if raw else ():
                        if named(headers).get("warc-type") == "response":
                            got = derive(headers, block, version)
                            held += got
                            back += [i] * len(got)
                            size += sum(len(g["record"]) for g in got)
                if size > 8 << 20:
                    yield out()
                    held, back, size = [], [], 0
            if held:
                yield out()

    return rows.mapInArrow(run, schema)
