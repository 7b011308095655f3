"""WARC archives: writing them, turning monolithic gzip into one member a record with an offset index, and reading back."""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.llm.shared import materialise, shared_dir

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
CHUNK = 1 << 20


#: The upper half of record ids; the page's id is the lower half.
ID_SPACE = uuid.NAMESPACE_URL.int >> 64


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=ID_SPACE << 64 | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: a response with HTTP header and payload, or a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = "".join(c for c in url or "" if c.isprintable())
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id)}"] if page_id is not None else [f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, clean + digest)}>", "X-Without-Id: true"]
    head += [f"WARC-Target-URI: {clean or 'urn:unknown'}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


class Inflated:
    """A gzip file, of one member or of several, read once from front to back; records are cut off as they come.

    CHUNK bytes at most are inflated at a time, however well they were compressed; what is held is a record and a chunk.
    """

    def __init__(self, file):
        self.file, self.held, self.ended = file, bytearray(), False
        self.member = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate some more; whether there was any."""
        while not self.ended:
            data = self.member.unconsumed_tail or self.member.unused_data or self.file.read(CHUNK)
            if self.member.eof and data:
                self.member = zlib.decompressobj(31)
            if not data:
                out = self.member.flush() if not self.member.eof else b""
                self.held += out
                if out:
                    return True
                self.ended = True
                if not self.member.eof:
                    raise EOFError("the archive ends inside a gzip member")
                return False
            out = self.member.decompress(data, CHUNK)
            self.held += out
            if out:
                return True
        return False

    def records(self) -> Iterator[tuple[bytes, dict[str, str]]]:
        """Each record's bytes as they stand, with the two line ends behind it, and its header fields."""
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self.more():
                    if self.held.strip():
                        raise EOFError("the archive ends inside a record")
                    return
            fields = headers(bytes(self.held[:end]))
            size = end + 4 + int(fields["content-length"]) + 4
            while len(self.held) < size:
                if not self.more():
                    raise EOFError("the archive ends inside a record")
            yield bytes(self.held[:size]), fields
            del self.held[:size]


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI or path, and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(fs: pafs.FileSystem, path: str, write) -> None:
    """Write a file under another name and then move it: a task that runs twice leaves one whole file."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        write(out)
    take_place(fs, draft, path)


def take_place(fs: pafs.FileSystem, draft: str, path: str) -> None:
    """Move a draft; where a file system does not replace files, an equal one from an earlier attempt goes first."""
    try:
        fs.move(draft, path)
    except OSError:
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(path)
        fs.move(draft, path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to) of every page. Of pages with equal payloads of at least `least` bytes, that with the smallest id is the response and
    refers_to leads the others there. Digests are grouped with partial sums and joined back to ids; a null id never is a response that others refer to."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1").select("digest", "first"))
    joined = rows.join(groups, "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits as archives, one for each task, each a single gzip stream; (archive, records) of each, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        fs.create_dir(base, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def stream(out):
            nonlocal n
            pack = zlib.compressobj(4, zlib.DEFLATED, 31)
            for batch in batches:
                for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(pack.compress(record(page_id, url, html.encode(), digest, refers)))
                    n += 1
            out.write(pack.flush())

        put(fs, f"{base}/{name}", stream)
        yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([n], pa.int64())})

    return materialise(rows.mapInArrow(write, "archive string, records bigint"))


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite monolithic archives with one gzip member a record, and a sidecar index (a JSON line for each record: offset, length, id, type).

    Each archive is inflated once, in chunks; a task holds one record and one chunk at a time, and index lines are written
    as records are. Archives of several members are taken as well. Returns (archive, records, bytes), stored; a cut-off archive is an error. Files are written under another name
    and moved, so a task that is run again replaces its files by equal ones.
    """
    spark = archives.sparkSession
    n = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        _, goal = place(target)
        fs.create_dir(goal, recursive=True)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                n, at = 0, 0

                def members(index, out, name=name):
                    nonlocal n, at
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                        for data, fields in Inflated(file).records():
                            pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                            member = pack.compress(data) + pack.flush()
                            out.write(member)
                            index.write(json.dumps({"offset": at, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}).encode() + b"\n")
                            n, at = n + 1, at + len(member)

                put(fs, f"{goal}/{name}.idx", lambda index, name=name, members=members: put(fs, f"{goal}/{name}", functools.partial(members, index)))
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return materialise(archives.select("archive").repartition(n).mapInArrow(rewrite, "archive string, records bigint, bytes bigint"))


def read_records(archives: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record, read member by member at the offsets of the index.

    Length and digest of a response are those of the payload read; a response that does not match its header is an error.
    A revisit has those of its header.
    """
    spark = archives.sparkSession
    n = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None, buffer_size=CHUNK) as index, fs.open_input_file(f"{base}/{name}") as file:
                    lines = io.TextIOWrapper(index, encoding="utf-8")
                    while part := list(itertools.islice(lines, 500)):
                        out = [one(zlib.decompress(file.read_at(e["length"], e["offset"]), 31)) for e in map(json.loads, part)]
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate(fields)})

    def one(data: bytes) -> tuple:
        head, _, rest = data.partition(b"\r\n\r\n")
        own = headers(head)
        block = rest[: int(own["content-length"])]
        digest, size = own["warc-payload-digest"].removeprefix("sha256:"), int(own["x-payload-length"])
        payload = None
        if own["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {own['warc-record-id']} does not match its header")
        page = None if "x-without-id" in own else page_of(own["warc-record-id"])
        refers = page_of(own["warc-refers-to"]) if "warc-refers-to" in own else None
        return (page, own["warc-target-uri"], size, digest, own["warc-type"], refers) + (payload,) * payloads

    return archives.select("archive").repartition(n).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write pages as archives in the shared folder (or `folder`, a URI that all executors reach), normalise them and read all records back.

    A null html counts as empty, a null url is recorded as unknown; rows without an id are written and come back without
    one. Rows that repeat an id get a record each; if theirs is the smallest id of a payload, all of them are responses.
    Pages without rows give no archives with records, and no rows. The files stay in the folder: the result reads them.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    written = write_archives(with_revisits(pages, id_col, url_col, html_col), f"{folder}/monolithic")
    return read_records(normalise(written, f"{folder}/monolithic", f"{folder}/members"), f"{folder}/members")
