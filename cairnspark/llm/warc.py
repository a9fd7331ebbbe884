"""WARC archives with an index that is written first and drives the reads.

Writing: each task streams its records into archives in the shared folder, one
gzip member a record, and returns an index row for every record (archive,
offset, length, URL, digest); the index is stored as a table.  A retried task
writes new files, and only those of the attempt that succeeded are in the index.
Of records with equal payloads of at least ``min_dedup`` bytes, that with the
largest page id is the response and the others are revisits without payload.

Reading: the selected index rows are dealt out by archive and stretch, sorted by
offset, and neighbouring ranges are joined into one read each.  Payloads are
checked against their digests.

Files are reached through pyarrow's file systems (file, hdfs, s3, gs).  Defined
results: a null payload is empty; a null page id is written as such and never
named by a revisit unless its whole group has none (then all are responses);
rows equal in page id and payload are all responses if theirs is the largest id;
control characters in a URL are percent-encoded in the archive; of equal
payloads the largest id is the response, whatever the order of rows; a very long
payload is one record, read alone; an empty table gives an empty index; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import named, new_path, spread_join, written
from .textbytes import tidied

MIN_DEDUP = 1000
#: An archive is closed at this size.
ARCHIVE_BYTES = 1 << 30
#: Ranges that lie at most GAP bytes apart are read at once, up to READ bytes (or one record); a task reads about TASK bytes, and no fewer than LEAST.
GAP, READ, TASK, LEAST = 64 << 10, 8 << 20, 64 << 20, 2 << 20
INDEX = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, archive string, offset long, length long"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; ``file:/x`` is taken as ``file:///x``."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, kind: str, refers_to, payload: bytes, size: int, digest: str) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and names the record it repeats."""
    from urllib.parse import quote

    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _typed(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_dedup: int) -> DataFrame:
    payload = F.encode(F.coalesce(named(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # only payloads that occur twice or more (small ones too, for the count of a hot one): pre-aggregated, small beside the pages
    top = F.when(F.col("payload_bytes") >= min_dedup, F.max("page_id"))
    same = written(rows.groupBy("payload_digest", "payload_bytes").agg(top.alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-copies")
    rows = spread_join(rows, same, ["payload_digest", "payload_bytes"], [F.col("page_id")], rows=5 * same.count(), n="n", how="left", wide=True, bound=common.WIDE_ROWS)
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup: int = MIN_DEDUP) -> DataFrame:
    """Write all ``pages`` into archives under ``folder`` and return the stored index."""

    def run(batches):
        import uuid
        import zlib

        import pyarrow as pa

        fs, root = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, size, digest, kind, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed one by one
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(record(page_id, url, kind, refers_to, payload, size, digest)) + z.flush()
                    out.write(data)
                    rows.append((page_id, url, kind, refers_to, size, digest, f"{folder}/{name}", at, len(data)))
                    at += len(data)
                ids = b.schema.field(0).type
                types = [ids, pa.string(), pa.string(), ids, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=names)
        finally:
            if out is not None:
                out.close()

    rows = _typed(pages, id_col, url_col, payload_col, min_dedup)
    return written(rows.mapInArrow(tidied(run), INDEX.format(id=dict(rows.dtypes)["page_id"])), "warc-index")


def read(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the index rows, as the archives have them: page_id, url, record_type, refers_to, payload_bytes, payload_digest, stored_bytes and payload (both null for revisits).

    Tasks are made by the bytes the index tells, and a batch of records is given out at about ``READ`` bytes.  Without
    ``payloads`` these are checked against their digests and dropped in the worker.
    """
    kind = dict(index.dtypes)["page_id"]
    names = ["page_id", "refers_to", "url", "record_type", "payload_bytes", "payload_digest", "stored_bytes", "payload"][: 7 + payloads]

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        held: dict = {}

        def ranges(rows):
            """Neighbouring (offset, length) joined into (start, end, rows)."""
            start = end = None
            part: list = []
            archive = None
            for a, offset, length in rows:
                if part and (a != archive or offset > end + GAP or offset + length > start + READ):
                    yield archive, start, end, part
                    part = []
                if not part:
                    archive, start, end = a, offset, offset
                part.append((offset, length))
                end = max(end, offset + length)
            if part:
                yield archive, start, end, part

        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary()][: 7 + payloads]

        def table(rows):
            cols = [list(c) for c in zip(*rows)] if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array([x or None for x in c] if i < 2 else c, t) for i, (c, t) in enumerate(zip(cols, types))], names=names)

        rows, held_bytes = [], 0
        for b in batches:
            for archive, start, end, part in ranges(zip(*[c.to_pylist() for c in b.columns])):
                if archive not in held:
                    for f in held.values():
                        f.close()
                    held.clear()
                    fs, path = filesystem(archive)
                    held[archive] = fs.open_input_file(path)
                data = memoryview(held[archive].read_at(end - start, start))
                for offset, length in part:
                    fields, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    whole = fields["warc-type"] == "response"
                    if whole and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"{archive}: payload at {offset} does not match its digest")
                    ids = [fields.get(k, "")[10:-1] for k in ("warc-record-id", "warc-refers-to")]
                    rows.append((*ids, fields["warc-target-uri"], fields["warc-type"], int(fields["warc-payload-length"]), digest, len(block) if whole else None, *([block if whole else None] if payloads else [])))
                    held_bytes += len(block) if payloads else 200
                    if held_bytes >= READ:
                        yield table(rows)
                        rows, held_bytes = [], 0
        yield table(rows)

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()["b"]
    tasks = max(-(-size // TASK), min(2 * index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST)), 1)
    stretch = max(size // (8 * tasks), LEAST // 4)  # several to a task, so that tasks are about even
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / stretch)).sortWithinPartitions("archive", "offset")
    fields = "page_id string, refers_to string, url string, record_type string, payload_bytes long, payload_digest string, stored_bytes int" + ", payload binary" * payloads
    out = dealt.mapInArrow(tidied(run), fields)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload_bytes", "payload_digest", "stored_bytes", *(["payload"] * payloads))


def round_trip(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write all pages, read all of them back by the index; without the payloads themselves."""
    index = write(pages, folder or new_path(pages.sparkSession, "warc"), **columns)
    return read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "stored_bytes")
