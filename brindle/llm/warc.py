"""WARC archives compressed with a Zstandard dictionary (operator 9).

Every file starts with a skippable frame that holds the dictionary; each record after it is a frame of its
own. The dictionary is trained on a bounded sample of the records that are archived. A record whose payload of at least
REVISIT_BYTES bytes another record has too is a revisit of the one with the largest page id.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import scratch_dir, written

#: Fixed values of the format.
SKIPPABLE, PROFILE = 0x184D2A5D, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables have none
REVISIT_BYTES = 1000
#: The sample that the dictionary is trained on, its size, and where a new file is begun.
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL, FILE_BYTES = 400, 8_000, 65_536, 3, 32 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(value) if value else None


def clean(url: str) -> str:
    """A URL as a header may hold it: control characters and spaces are escaped."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, owner: int | None) -> bytes:
    """One record; ``owner`` is the page that a revisit refers to."""
    block = b"" if owner is not None else HTTP % len(payload) + payload
    headers = [
        ("WARC-Type", "response" if owner is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else clean(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), ("WARC-Refers-To", None if owner is None else urn(owner)), ("WARC-Profile", None if owner is None else PROFILE),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; few or small ones do not suffice for training and serve as raw content."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def opening(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def sampled_dictionary(pages: DataFrame, id_column: str, url: str, payload: str) -> bytes:
    total = max(1, pages.count())
    chosen = pages.where(F.col(payload).isNotNull() & (F.pmod(F.xxhash64(id_column, payload), F.lit(total)) < SAMPLE_RECORDS))
    rows = chosen.select(F.col(id_column).alias("i"), F.col(url).alias("u"), F.substring(payload, 1, SAMPLE_CHARS).alias("p")).limit(2 * SAMPLE_RECORDS).collect()
    data = sorted(record(r["i"], r["u"], r["p"].encode(), hashlib.sha1(r["p"].encode()).digest(), None) for r in rows)
    return train(data)


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives under ``path`` and returns the table of files (path, n_records, n_bytes) that belong to them.

    File names carry the task attempt, so that a task that is run again leaves only files that are not in the table.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    dictionary = pages.sparkSession.sparkContext.broadcast(sampled_dictionary(pages, id_column, url, payload))
    equal = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    placed = rows.join(equal, "digest", "left").withColumn("owner", F.when(~F.coalesce(F.col("owner") == F.col("page_id"), F.lit(False)), F.col("owner")))
    placed = placed.withColumn("size", F.octet_length("payload").cast("bigint"))
    # The payload of a revisit is not written.
    placed = placed.select("page_id", "url", F.when(F.col("owner").isNull(), F.col("payload")).cast("binary").alias("payload"), "digest", "owner", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dictionary.value
        known = zstandard.ZstdCompressionDict(held) if held else None
        if known:
            known.precompute_compress(level=LEVEL)
        pressed = zstandard.ZstdCompressor(dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0

        def close() -> None:
            nonlocal out, n, size
            if out is not None:
                out.close()
                done.append((name, n, size))
            out, n, size = None, 0, 0

        for batch in batches:
            for page_id, address, data, digest, owner, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    task = TaskContext.get()
                    name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    # Without this the library packs files of such a name once more, and unpacks them when reading.
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(opening(held))
                whole = record(page_id, address, data or b"", bytes.fromhex(digest), owner)
                if owner is not None:
                    whole = whole.replace(b"X-Payload-Length: 0\r\n", b"X-Payload-Length: %d\r\n" % length)
                frame = pressed.compress(whole)
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    files = placed.mapInArrow(run, "path string, n_records bigint, n_bytes bigint")
    return written(files).select(F.concat(F.lit(path.rstrip("/") + "/"), "path").alias("path"), "n_records", "n_bytes")


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file, as a stream."""
    dictionary, rest = None, io.BufferedReader(stream, 1 << 20)
    while len(head := rest.peek(8)[:8]) == 8 and struct.unpack("<I", head[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:
        magic, size = struct.unpack("<II", rest.read(8))
        frame = rest.read(size)
        if magic == SKIPPABLE:
            dictionary = zstandard.ZstdCompressionDict(frame)
    opened = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    lines = io.BufferedReader(opened.stream_reader(rest, read_across_frames=True), 1 << 20)
    while first := lines.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {}
        while (line := lines.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        block = lines.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]) or lines.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield headers, block


def read_warc(spark: SparkSession, files: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; with ``payloads`` also payload.

    ``files`` is (path, n_records). A payload that does not hash to its record's digest, or a file with another number of records, fails the job. A revisit has the digest and length that it declares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        count = 6 if payloads else 5
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(count)], names[:count])
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                rows, held, count_read = [], 0, 0
                with store.open_input_stream(place, compression=None) as stream:
                    for headers, block in records(stream):
                        declared = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        body, size = None, int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(body).hexdigest() != declared or len(body) != size:
                                raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
                        rows.append((page_of(headers["WARC-Record-ID"]), size, declared, headers["WARC-Type"], page_of(headers.get("WARC-Refers-To")), body))
                        held += len(block) if payloads else 0
                        count_read += 1
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield make(rows)
                            rows, held = [], 0
                if count_read != expected:
                    raise ValueError(f"{path} is cut short: {count_read} records of {expected}")
                yield make(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    return files.select("path", "n_records").repartition(parts).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives (page_id, url, html) rows and reads the archives back: see ``read_warc``.

    Page ids are whole numbers; others are an error. A null html is an empty payload, a null URL leaves out the header, a null page id comes back as null; a record of it is the response of equal
    payloads only if all of them have no id. Rows that repeat the largest page id of equal payloads are all responses.
    Other columns are not read; an empty table gives no record.
    """
    spark = pages.sparkSession
    if dict(pages.dtypes)["page_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("page ids are whole numbers")
    return read_warc(spark, write_warc(pages, path or scratch_dir(spark)))
