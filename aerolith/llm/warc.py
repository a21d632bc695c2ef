"""WARC archives as a chunked record table.

A payload is cut into chunks; each chunk is one row (record identifier, chunk number)
and one WARC record of its own, a segment: the first segment is the response or revisit
record, later ones are continuation records that name it. Each carries the SHA-1 of the
payload so far, so a reader checks a record chunk by chunk and nobody holds a whole
record besides the input cell that it came in. Spark's text writer puts the rows into
the archive files and its text reader takes them apart at the start of every record.

Defined cases: a null payload is an empty one; a null identifier is written as "null";
rows that repeat identifier and payload are written each, with one type; an empty table
gives no record; other columns are never read. A payload may hold the record separator:
the writer cuts a chunk inside it.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

CHUNK = 1 << 16
SMALLEST_REVISIT = 1000
#: What stands between two records, up to the value of the first field of the next one.
SEPARATOR = "\r\n\r\nWARC/1.1\r\nWARC-Type: "
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROWS = "record_id string, chunk_no long, total_bytes long, digest string, record_type string, value string"
PARTS = "record_id string, chunk_no long, record_type string, refers_to string, payload_bytes long, payload_digest string"


def record_types(pages, id_col="page_id", payload_col="html", least=SMALLEST_REVISIT):
    """Per (identifier, digest): the record type and what it refers to.

    Of equal payloads of at least `least` bytes the largest identifier is the response.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    seen = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("p")).select(
        "id", F.sha1(F.col("p").cast("binary")).alias("sha"), F.octet_length("p").cast("long").alias("size"))
    small = F.col("size") < least
    first = seen.where(~small).groupBy("sha", "size").agg(F.max("id").alias("winner"))
    own = seen.distinct()
    joined = own.join(first, ["sha", "size"], "left")
    again = F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("id"))
    return joined.select("id", "sha", F.when(again, "revisit").otherwise("response").alias("kind"),
                         F.when(again, F.col("winner")).alias("refers"))


def cuts(data, chunk=CHUNK):
    """Ends of the chunks of UTF-8 bytes: never inside a character or after a whole separator."""
    ends, at, size = [], 0, len(data)
    mark = SEPARATOR.encode()
    inside = [m.start() + 6 for m in re.finditer(re.escape(mark), data)]
    inside.reverse()
    while at < size:
        end = min(at + chunk, size)
        while end < size and data[end] & 0xC0 == 0x80:
            end -= 1
        while inside and inside[-1] <= at:
            inside.pop()
        if inside and inside[-1] < end:
            end = inside[-1]
        ends.append(end)
        at = end
    return ends or [0]


def _header(kind, fields, length):
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None),
             f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _chunk_rows(chunk):
    def make(batches):
        for batch in batches:
            names = ["id", "url", "payload", "kind", "refers"]
            out = []
            ids, urls, payloads, kinds, refers = (batch.column(batch.schema.get_field_index(n)) for n in names)
            for i in range(batch.num_rows):
                record = ids[i].as_py()
                record = "null" if record is None else str(record)
                # Header fields are lines: a line end inside an address would start another field.
                url = re.sub(r"[\x00-\x20\x7f]+", "%20", urls[i].as_py() or "") or "urn:none"
                data = memoryview(payloads[i].as_buffer())
                kind, other, total = kinds[i].as_py(), refers[i].as_py(), len(data)
                sha = hashlib.sha1()
                if kind == "revisit":
                    sha.update(data)
                    spans = [(0, 0)]
                else:
                    ends = cuts(data, chunk)
                    spans = list(zip([0, *ends[:-1]], ends))
                for number, (a, b) in enumerate(spans, 1):
                    part = data[a:b]
                    if kind != "revisit":
                        sha.update(part)
                    digest = sha.hexdigest()
                    last = number == len(spans)
                    fields = [("WARC-Record-ID", f"<urn:page:{record}:{number}>"), ("WARC-Date", DATE),
                              ("WARC-Segment-Number", number if len(spans) > 1 else None)]
                    http = b""
                    if number == 1:
                        http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                                f"Content-Length: {total}\r\n\r\n").encode()
                        fields += [("WARC-Target-URI", url),
                                   ("Content-Type", "application/http; msgtype=response"),
                                   ("WARC-Profile", PROFILE if kind == "revisit" else None),
                                   ("WARC-Refers-To", f"<urn:page:{other}:1>" if kind == "revisit" else None)]
                    else:
                        fields += [("WARC-Segment-Origin-ID", f"<urn:page:{record}:1>"),
                                   ("WARC-Segment-Total-Length", total if last else None)]
                    # The digest of the payload up to the end of this chunk.
                    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
                    head = _header(kind if number == 1 else "continuation", fields, len(http) + len(part))
                    value = b"".join((head, http, part, b"\r\n"))
                    out.append((record, number, total, digest, kind, value.decode()))
                    if len(out) >= 256:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    return make


def _rows(out):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROWS.split(", ")])


def chunk_table(pages, id_col="page_id", url_col="url", payload_col="html", chunk=CHUNK):
    """The chunked record table: one row per record and chunk, in the order of the archive."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    given = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.cast("binary").alias("payload"),
                         F.sha1(payload.cast("binary")).alias("sha"))
    types = record_types(pages, id_col, payload_col)
    typed = given.alias("g").join(types.alias("t"), F.expr("g.id <=> t.id AND g.sha = t.sha")).select(
        "g.id", "g.url", "g.payload", "t.kind", "t.refers")
    return typed.mapInArrow(_chunk_rows(chunk), ROWS)


def write(pages, path, **options):
    """Write the records of pages into archive files below path; returns path."""
    chunk_table(pages, **options).select("value").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    return path


def _parse(batches):
    """Records of a partition in file order to one row per record; chunks are digested as they pass."""
    out, open_record = [], None

    def close(record):
        if record["kind"] == "response" and record["bytes"] != record["total"]:
            raise ValueError(f"record {record['id']}: {record['bytes']} of {record['total']} bytes")
        return (record["id"], record["chunks"], record["kind"], record["refers"], record["total"], record["digest"])

    for batch in batches:
        for value in batch.column(0):
            data = memoryview(value.as_buffer())
            whole = bytes(data[:4096])
            end = whole.find(b"\r\n\r\n")
            if end < 0:
                whole = bytes(data)
                end = whole.find(b"\r\n\r\n")
            lines = whole[:end].decode().split("\r\n")
            kind = lines[1].partition(": ")[2] if lines[0].startswith("WARC/") else lines[0]
            fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
            body = data[end + 4:end + 4 + int(fields["Content-Length"])]
            declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            name, _, number = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">").rpartition(":")
            if kind == "continuation":
                if open_record is None or open_record["id"] != name or open_record["chunks"] + 1 != int(number):
                    raise ValueError(f"record {name}: segment {number} without the one before it")
                open_record["chunks"] += 1
                part = body
            else:
                if open_record is not None:
                    out.append(close(open_record))
                head = bytes(body[:4096]).partition(b"\r\n\r\n")[0]
                part = body[len(head) + 4:]
                refers = fields.get("WARC-Refers-To")
                open_record = {
                    "id": name, "chunks": 1, "kind": kind, "sha": hashlib.sha1(), "bytes": 0,
                    "total": int(re.search(rb"Content-Length: (\d+)", head)[1]),
                    "refers": refers and refers.removeprefix("<urn:page:").partition(":")[0]}
            if open_record["kind"] == "response":
                open_record["sha"].update(part)
                open_record["bytes"] += len(part)
                if open_record["sha"].hexdigest() != declared:
                    raise ValueError(f"record {name}: digest differs in segment {number}")
            open_record["digest"] = declared
        if len(out) >= 1024:
            yield _parts(out)
            out = []
    if open_record is not None:
        out.append(close(open_record))
    if out:
        yield _parts(out)


def _parts(out):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                      names=[f.split()[0] for f in PARTS.split(", ")])


def read(spark, path):
    """One row per record of the archives below path: type, length and SHA-1 of the payload.

    chunk_no is the number of chunks. Archives are compressed, so a file is one task's and
    its records come in order; a record never spans two files.
    """
    rows = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(_parse, PARTS)
