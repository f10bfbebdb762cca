"""WARC archives of pages with a two-level capture index.

Every page becomes one gzip member of an archive: a response with its payload, or a revisit
that refers to the response with the same payload. The index holds one line for each
capture, sorted by a URL key with the host reversed, in compressed blocks; a sparse
directory holds the first key and the place of each block. A lookup searches the directory
by bisection over byte positions, reads the one block by its range, and then the record by
its range. Neither a whole index nor a whole archive is ever held.

Files are written by the tasks under names of their own attempt, and only names that come
back from finished tasks are used, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import in_slices
from worksight.sources.scratch import stored

BLOCK_LINES = 3_000  # captures in a compressed block of the index
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # capture time of tables that have none
OPEN_FILES = 8
# Names of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_ID = "urn:x-page:"


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def url_key(url: str | None) -> str:
    """The URL with its host reversed, so that a site's captures stand together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:  # not a URL: its own text
        return f"){url}"
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}){parts.path or '/'}{query}"


def _order(key: str, page_id) -> tuple:
    """Spark's order of (key, page_id): by bytes, missing ids first."""
    if isinstance(page_id, str):
        page_id = page_id.encode()
    return (key.encode(), page_id is not None, 0 if page_id is None else page_id)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member. Line breaks inside a value would end the header and are encoded."""
    lines = ["WARC/1.1"]
    for name, value in headers:
        value = value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"{name}: {value}")
    lines.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    headers = {}
    for line in data[:end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name] = value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    length = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + length]


def _id_text(page_id) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def _id_of(text: str, as_int: bool):
    bare = text[1 + len(_ID) : -1]
    if not bare and as_int:
        return None
    return int(bare) if as_int else bare


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _typed(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages beside the page of the same payload that they revisit, null for a response.

    Groups are found on digests alone; the payloads then meet the few facts of their own
    page, so a payload that a third of all pages have loads no task.
    """
    facts = pages.select(
        "page_id", "url", "sha", F.octet_length("html").alias("size")
    ).where(F.col("size") >= min_bytes)
    groups = (
        facts.groupBy("sha")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    revisits = (
        facts.select("page_id", "sha")
        .join(groups, "sha")
        .where(~F.col("page_id").eqNullSafe(F.col("first_id")))
        .distinct()
        .withColumnsRenamed({"page_id": "own_id", "sha": "own_sha"})
    )
    own = pages["page_id"].eqNullSafe(F.col("own_id")) & (pages["sha"] == F.col("own_sha"))
    return pages.join(revisits, own, "left").select(
        "page_id", "url", "html", F.col("own_sha").isNotNull().alias("again"), "first_id", "first_url"
    )


class Archive(NamedTuple):
    """Where a set of archives and their index lie: captures by row, parts of the index."""

    folder: str
    captures: DataFrame
    parts: DataFrame
    int_ids: bool


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> Archive:
    """Write a record for every row of ``pages``, and the index of all captures.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one of the largest id is
    the response (all rows of that id, if it repeats) and the others revisit it; shorter
    payloads are responses each. A null html is an empty payload, a null URL an empty one,
    a null id the smallest.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        html.alias("html"),
        F.sha1(html).alias("sha"),
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    int_ids = kind in ("bigint", "int", "smallint", "tinyint")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        stream, offset = None, 0
        for batch in in_slices(batches):
            if stream is None:
                files, root = _at(folder)
                files.create_dir(root, recursive=True)
                stream = files.open_output_stream(f"{root}/{name}", compression=None)
            keys, ids, urls, offsets, lengths = [], [], [], [], []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for page_id, url, payload, again, first_id, first_url in zip(*columns, strict=True):
                headers = [
                    ("WARC-Type", "revisit" if again else "response"),
                    ("WARC-Record-ID", _id_text(page_id)),
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", url),
                    ("Content-Type", "application/http;msgtype=response"),
                    ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
                ]
                block = HTTP_HEAD
                if again:
                    headers += [
                        ("WARC-Profile", PROFILE),
                        ("WARC-Refers-To", _id_text(first_id)),
                        ("WARC-Refers-To-Target-URI", first_url),
                    ]
                else:
                    block += payload
                member = _record(headers, block)
                stream.write(member)
                keys.append(url_key(url))
                ids.append(page_id)
                urls.append(url)
                offsets.append(offset)
                lengths.append(len(member))
                offset += len(member)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.string()),
                    batch.column(0),
                    pa.array(urls, pa.string()),
                    pa.array([name] * len(ids), pa.string()),
                    pa.array(offsets, pa.int64()),
                    pa.array(lengths, pa.int64()),
                ],
                names=names,
            )
        if stream is not None:
            stream.close()

    names = "key page_id url file offset length".split()
    schema = f"key string, page_id {kind}, url string, file string, offset bigint, length bigint"
    captures = stored(_typed(rows, min_bytes).mapInArrow(write, schema), "captures")
    return Archive(folder, captures, _write_index(captures, folder), int_ids)


def _write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Blocks and directory; returns one row for each part, its first key and file names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        lines: list[str] = []
        first = None
        blocks = directory = None
        offset = 0

        def flush() -> int:
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress("\n".join(lines).encode()) + packer.flush()
            blocks.write(member)
            key, page_id = json.loads(lines[0])[:2]
            entry = json.dumps([key, page_id, offset, len(member)])
            directory.write(entry.encode() + b"\n")
            return len(member)

        for batch in in_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blocks is None:
                    files, root = _at(folder)
                    files.create_dir(root, recursive=True)
                    blocks = files.open_output_stream(
                        f"{root}/{name}.cdx.gz", compression=None
                    )
                    directory = files.open_output_stream(f"{root}/{name}.idx")
                    first = row[0]
                lines.append(json.dumps(row))
                if len(lines) == BLOCK_LINES:
                    offset += flush()
                    lines.clear()
        if blocks is None:
            return
        if lines:
            flush()
        blocks.close()
        directory.close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([context.partitionId()], pa.int32()),
                pa.array([first], pa.string()),
                pa.array([name], pa.string()),
            ],
            names=["part", "first_key", "name"],
        )

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(ordered.mapInArrow(write, "part int, first_key string, name string"), "index")


class _Part:
    """One part of the index: bisection in its directory, then one block."""

    def __init__(self, folder: str, name: str):
        files, root = _at(folder)
        self.directory = files.open_input_file(f"{root}/{name}.idx")
        self.blocks = files.open_input_file(f"{root}/{name}.cdx.gz")
        self.size = self.directory.size()
        self.block: tuple[int, list, list] | None = None

    def _line(self, at: int) -> tuple[int, list, int]:
        """The first directory line that starts at or after a byte: start, entry, end."""
        start = at
        if at:
            self.directory.seek(at - 1)
            start = at - 1 + len(self._until_newline())
        if start >= self.size:
            return start, [], start
        self.directory.seek(start)
        line = self._until_newline()
        return start, json.loads(line), start + len(line)

    def _until_newline(self) -> bytes:
        parts = []
        while data := self.directory.read(512):
            end = data.find(b"\n")
            parts.append(data if end < 0 else data[: end + 1])
            if end >= 0:
                break
        return b"".join(parts)

    def _entry(self, wanted: tuple) -> tuple[int, list]:
        """Start of the last directory line not after ``wanted``, or of the first; the line."""
        low, high = 0, self.size  # a line at or before ``low`` is known not to be after it
        found = self._line(0)
        while low < high:
            middle = (low + high) // 2
            start, entry, end = self._line(middle)
            if entry and _order(*entry[:2]) < wanted:
                found, low = (start, entry, end), max(end, middle + 1)
            else:
                high = middle
        return found[0], found[1]

    def captures(self, key: str, page_id) -> Iterator[list]:
        """Index lines of this key and id; equal ones may go on in the following blocks."""
        wanted = _order(key, page_id)
        start, entry = self._entry(wanted)
        while entry and _order(*entry[:2]) <= wanted:
            if self.block is None or self.block[0] != start:
                self.blocks.seek(entry[2])
                text = zlib.decompress(self.blocks.read(entry[3]), 31).decode()
                lines = [json.loads(line) for line in text.split("\n")]
                self.block = (start, lines, [_order(*line[:2]) for line in lines])
            _, lines, keys = self.block
            at = bisect.bisect_left(keys, wanted)
            while at < len(keys) and keys[at] == wanted:
                yield lines[at]
                at += 1
            if at < len(keys):
                return
            start, entry, _ = self._line(start + 1)


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The captures of each distinct (page_id, url) of ``wanted``, found through the index.

    Returns url, page_id, file, offset and length; nothing for a page that is not there.
    Wanted rows are sorted like the index, so a task reads each block it needs once. The
    driver holds the first key of each index part, one short row for each task that wrote.
    """
    parts = [
        (row["first_key"], row["name"])
        for row in archive.parts.orderBy("part").select("first_key", "name").collect()
    ]
    firsts = [key.encode() for key, _ in parts]
    folder = archive.folder

    @F.pandas_udf("string")
    def keys(urls):
        return urls.map(url_key)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, _Part] = {}
        for batch in in_slices(batches):
            found: list[list] = []
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for key, page_id, url in zip(*columns, strict=True):
                # parts that may hold the key: the last that starts before it, and those
                # that start with it
                low = max(0, bisect.bisect_left(firsts, key.encode()) - 1)
                high = bisect.bisect_right(firsts, key.encode())
                for k in range(low, high):
                    if k not in opened:
                        if len(opened) >= OPEN_FILES:
                            opened.clear()
                        opened[k] = _Part(folder, parts[k][1])
                    found += [line for line in opened[k].captures(key, page_id) if line[2] == url]
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.string(), batch.column(1).type, pa.string(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[1:], names=names[1:])

    names = "key page_id url file offset length".split()
    kind = archive.captures.schema["page_id"].dataType.simpleString()
    rows = wanted.select("page_id", F.coalesce("url", F.lit("")).alias("url")).distinct()
    keyed = stored(rows.select(keys("url").alias("key"), "page_id", "url"), "wanted")
    ordered = keyed.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(
        find, f"page_id {kind}, url string, file string, offset bigint, length bigint"
    )


def read_records(archive: Archive, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of these captures, each read by its range, in the order of the archives.

    Columns: page_id, url, record_type, refers_to, stated_digest (of the header), and of a
    response payload_bytes, payload_digest (both of the payload read) and payload.
    """
    folder, int_ids = archive.folder, archive.int_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(folder)
        name, stream = None, None
        for batch in in_slices(batches):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            for file, offset, length in zip(*columns, strict=True):
                if file != name:
                    name, stream = file, files.open_input_file(f"{root}/{file}")
                stream.seek(offset)
                headers, block = _parsed(stream.read(length))
                again = headers["WARC-Type"] == "revisit"
                payload = None if again else block[len(HTTP_HEAD) :]
                refers = headers.get("WARC-Refers-To")
                rows.append(
                    (
                        _id_of(headers["WARC-Record-ID"], int_ids),
                        headers["WARC-Target-URI"],
                        headers["WARC-Type"],
                        _id_of(refers, int_ids) if refers else None,
                        headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                        None if again else len(payload),
                        None if again else payload_digest(payload),
                        payload if with_payload else None,
                    )
                )
            values = list(zip(*rows, strict=True)) or [()] * len(names)
            page_type = pa.int64() if int_ids else pa.string()
            text = pa.string()
            kinds = [page_type, text, text, page_type, text, pa.int64(), text, pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = (
        "page_id url record_type refers_to stated_digest payload_bytes payload_digest payload"
    ).split()
    kind = "bigint" if int_ids else "string"
    schema = (
        f"page_id {kind}, url string, record_type string, refers_to {kind}, "
        "stated_digest string, payload_bytes bigint, payload_digest string, payload binary"
    )
    places = captures.select("file", "offset", "length")
    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, schema)


def read_back(archive: Archive, wanted: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of wanted pages.

    A revisit's payload is that of the response it refers to, which must be wanted too.
    """
    found = read_records(archive, lookup(archive, wanted), with_payload=False)
    records = stored(found.drop("payload"), "records")
    columns = "page_id url payload_bytes payload_digest record_type refers_to".split()
    responses = records.where("record_type = 'response'")
    originals = responses.select(
        F.col("page_id").alias("original"),
        "payload_digest",
        "payload_bytes",
    ).distinct()
    revisits = records.where("record_type = 'revisit'").select(
        "page_id", "url", "record_type", "refers_to", "stated_digest"
    )
    same = revisits["refers_to"].eqNullSafe(originals["original"]) & (
        revisits["stated_digest"] == originals["payload_digest"]
    )
    followed = revisits.join(originals, same)
    return responses.select(*columns).unionByName(followed.select(*columns))
