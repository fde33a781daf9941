"""WARC archives: written with an index of every record, read back by coalesced byte ranges."""

from __future__ import annotations

import functools
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_folder, small_batches, stored

#: Payloads under this many bytes are never revisits.
LEAST_SHARED = 100
#: A payload with one in so many of all rows whose payload is shared is hot: there are HOT of them at most, few enough to broadcast.
HOT = 4096
ROLL_BYTES, GAP_BYTES, RANGE_BYTES = 512 << 20, 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


@functools.cache
def _filesystem(uri: str):
    """The file system and path of a URI; any that Arrow knows (local, hdfs, s3, gs)."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with its HTTP block, or a revisit of an equal payload without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record, the payload's length and digest worked out from what was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of pages under folder and return the stored index, one row a record.

    Records are gzip members of .warc.gz files, a file or more for each task attempt; the index names only
    files of attempts that were committed, so leftovers of lost executors are never read. Of rows with equal
    payloads of LEAST_SHARED bytes or more, those with the smallest id are responses and the others revisits;
    rows whose group has no id at all are responses. Null html is an empty payload; rows may repeat, an empty table
    gives an empty index. The smallest id of a payload is found by a map-side minimum. Only payloads that some row
    shares meet under one key: a hot one (a payload in HOT at least) is looked up where its rows are read, and a
    short or hot payload goes by its row.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    copies = rows.where(F.col("n") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = stored(copies.where("copies > 1"))
    shared = firsts.agg(F.sum("copies")).first()[0] or 0
    hot = firsts.where(F.col("copies") >= max(-(-shared // HOT), 2)).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    own = F.concat_ws(" ", F.lit("own"), F.col("page_id").cast("string"), F.xxhash64("url").cast("string"))
    apart = (F.col("n") < LEAST_SHARED) | F.col("hot").isNotNull()
    keyed = rows.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(apart, own).otherwise(F.col("digest")))
    first = F.coalesce("hot_first", "first")
    placed = keyed.join(firsts.select(F.col("digest").alias("key"), "first"), "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(~first.eqNullSafe(F.col("page_id")), first).alias("refers_to")
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = {k: [] for k in (x.split()[0] for x in INDEX.split(", "))}
        sink, at, part, name = None, 0, 0, ""
        fs, top = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None or at >= ROLL_BYTES:
                    if sink is not None:
                        sink.close()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:03d}.warc.gz"
                    part, at = part + 1, 0
                    fs.create_dir(top, recursive=True)
                    sink = fs.open_output_stream(f"{top}/{name}", compression=None)
                    info = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
                    at += sink.write(_gzip(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (record_id(None, name).encode(), DATE.encode(), len(info), info)))
                packed = _gzip(record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                sink.write(packed)
                values = (row["page_id"], row["url"], f"{folder}/{name}", at, len(packed), row["digest"], len(row["payload"]), "response" if row["refers_to"] is None else "revisit", row["refers_to"])
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
                at += len(packed)
            if len(out["page_id"]) >= 5000:
                yield _batch(out)
                out = {k: [] for k in out}
        if sink is not None:
            sink.close()
        yield _batch(out)

    return stored(placed.mapInArrow(archive, INDEX))


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = dict(x.split() for x in (INDEX + ", " + RECORD).split(", "))
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[kinds[k]]) for k, v in columns.items()], names=list(columns))


def ranges(places: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[int]]]:
    """(file, start, end, which): sorted record places merged into reads that skip at most GAP_BYTES and stay near RANGE_BYTES."""
    found: list[tuple[str, int, int, list[int]]] = []
    for k in sorted(range(len(places)), key=lambda k: places[k]):
        file, offset, length = places[k]
        if found and found[-1][0] == file and offset - found[-1][2] <= GAP_BYTES and offset + length - found[-1][1] <= RANGE_BYTES:
            last = found[-1]
            found[-1] = (file, last[1], max(last[2], offset + length), [*last[3], k])
        else:
            found.append((file, offset, offset + length, [k]))
    return found


def read(selected: DataFrame, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """The records that rows of an index name, read by byte ranges; rows of RECORD, without payloads if not asked for.

    The index rows are range-partitioned by file and offset, so that each task reads neighbouring records in
    few large reads; every response's length and digest are checked against its header. A damaged record stops the
    job, or with damaged="report" gives a row of the type damaged whose url is the file and the offset, all else null.
    """
    if damaged not in ("raise", "report"):
        raise ValueError(f"damaged must be raise or report, not {damaged}")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for file, start, end, which in ranges(places):
                fs, path = _filesystem(file)
                with fs.open_input_file(path) as source:
                    data = source.read_at(end - start, start)
                out = {k: [] for k in names}
                for k in which:
                    offset, length = places[k][1] - start, places[k][2]
                    try:
                        found = parse_record(zlib.decompress(memoryview(data)[offset : offset + length], 31))
                    except (ValueError, KeyError, zlib.error):
                        if damaged == "raise":
                            raise
                        found = {**dict.fromkeys(names), "url": f"{file}:{places[k][1]}", "record_type": "damaged"}
                    if not payloads:
                        found["payload"] = None
                    for name in names:
                        out[name].append(found[name])
                yield _batch(out)

    wanted = selected.select("file", "offset", "length")
    partitions = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartitionByRange(partitions, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)


def records_of(data: bytes) -> Iterator[dict]:
    """Every record of one archive in order, without its index; for checks of small files."""
    stream = io.BytesIO(data)
    while chunk := stream.read():
        packer = zlib.decompressobj(31)
        whole = packer.decompress(chunk)
        stream = io.BytesIO(packer.unused_data)
        if b"WARC-Type: warcinfo" not in whole.split(b"\r\n\r\n", 1)[0]:
            yield parse_record(whole)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read every record back by the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write(pages, folder or f"{shared_folder(pages.sparkSession)}-warc")
    back = read(index, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
