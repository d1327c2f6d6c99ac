"""WARC archives with Zstandard frames: writer and reader.

An archive file starts with a skippable frame that holds the compression
dictionary; after it comes one frame per record, so any record can be decoded
by itself.  The reader takes the dictionary from the file it reads, walks the
frames, and checks every record's headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C

SKIPPABLE = 0x184D2A5D
#: A file is closed when its payloads reach this size, which bounds what a reader holds.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on this many payloads at most, cut to SAMPLE_BYTES each.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 400, 16 << 10, 32 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, "
          "payload_digest string, archive string, frame_start long, frame_length long, payload binary")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def encode_record(page_id, url: str | None, payload: bytes, refers_to, payload_digest: str) -> bytes:
    """One WARC/1.1 record; a revisit carries no block, only the size and digest of its payload."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", "sha1:" + payload_digest), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        block = b""
    else:
        head += [("Content-Type", "text/html; charset=utf-8")]
        block = payload
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Headers and block of one record; ValueError names what does not hold."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("record header is not ended")
    version, *lines = raw[:cut].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    head = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep or not name.strip():
            raise ValueError(f"bad header line {line[:40]!r}")
        head[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise ValueError(f"header {need} is missing")
    length = int(head["content-length"])
    block, tail = raw[cut + 4:cut + 4 + length], raw[cut + 4 + length:]
    if length < 0 or len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"record block is not {length} bytes")
    kind, want = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (digest(block) != want or int(head.get("x-payload-length", length)) != length):
        raise ValueError("payload does not match its digest or length")
    if kind == "revisit" and not (length == 0 and want and head.get("warc-refers-to")):
        raise ValueError("revisit record without digest, reference or with a block")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind!r}")
    return head | {"block": block}


def _page(ref: str):
    name = ref.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def frames(data: bytes):
    """(dictionary bytes, iterator of (start, length, record bytes)) of one archive file."""
    import zstandard
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("dictionary frame is cut off")
        dictionary, at = data[8:8 + size], 8 + size
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)

    def walk():
        pos = at
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        while pos < len(data):
            one = d.decompressobj()
            raw = one.decompress(memoryview(data)[pos:])
            if not one.eof:
                raise ValueError(f"frame at {pos} is cut off")
            size = len(data) - pos - len(one.unused_data)
            yield pos, size, raw
            pos += size
    return dictionary, walk()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; empty when there is too little to learn from."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _writer(folder: str, dictionary: bytes, archive_bytes: int):
    def run(batches):
        import zstandard
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True,
                                          dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        number, held, size, count = 0, [], 0, 0
        done = []

        def close():
            nonlocal number, held, size, count
            # written under a name of this attempt, then moved: a task that is run again replaces its own file
            name = f"part-{part:06d}-{number:04d}.warc.zst"
            temp = f"{base}/_tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                if dictionary:
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                for x in held:
                    out.write(x)
            store.move(temp, f"{base}/{name}")
            done.append((name, count))
            number, held, size, count = number + 1, [], 0, 0

        for b in C.slices(batches, rows=512, data_bytes=8 << 20, text="html"):
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page, url, html, ref in zip(*cols):
                payload = (html or "").encode("utf-8")
                held.append(packer.compress(encode_record(page, url, payload, ref, digest(payload))))
                size, count = size + len(payload), count + 1
                if size >= archive_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])
    return run


def references(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit an equal payload of a smaller page_id."""
    text = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", F.sha1(text).alias("sha"), F.length(text).alias("size")).where(F.col("size") >= min_bytes)
    first = p.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return (p.join(first, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct())


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, *, min_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as .warc.zst files into ``folder``; returns (archive, records).

    Pages whose payload (at least ``min_bytes`` long) equals that of a page with a
    smaller id become revisit records.  A NULL html is an empty payload; rows with
    a NULL page_id are response records.  Rows repeated whole are written as often
    as they occur.  The folder may be on any file system pyarrow knows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    samples = [bytes(r[0]) for r in pages.where("length(html) > 0").select(
        F.encode(F.substring("html", 1, SAMPLE_BYTES), "UTF-8")).limit(SAMPLE_ROWS).toLocalIterator()]
    ref = references(pages, min_bytes)
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = (pages.withColumn("sha", sha).join(ref, ["page_id", "sha"], "left")
            .select("page_id", "url", "html", "refers_to"))
    return rows.mapInArrow(_writer(folder, train_dictionary(samples), archive_bytes), "archive string, records long")


def _reader(with_payload: bool):
    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                _, walk = frames(content.as_py())
                rows = []
                for start, size, raw in walk:
                    r = decode_record(raw)
                    rows.append((_page(r["warc-record-id"]), r["warc-type"],
                                 _page(r["warc-refers-to"]) if r["warc-type"] == "revisit" else None,
                                 r.get("warc-target-uri"), int(r.get("x-payload-length", len(r["block"]))),
                                 r["warc-payload-digest"].removeprefix("sha1:"), path.rsplit("/", 1)[-1], start, size,
                                 r["block"] if with_payload else None))
                    if len(rows) >= 512:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
    return run


def _batch(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all .warc.zst files in ``folder`` (columns FIELDS).

    A damaged frame, header, length or digest raises ValueError and fails the job:
    records are never skipped silently.  An empty folder gives no row.
    """
    files = (spark.read.schema("path string, modificationTime timestamp, length long, content binary")
             .format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder))
    return files.select("path", "content").mapInArrow(_reader(with_payload), FIELDS)


def round_trip(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    archive, frame_start, frame_length."""
    folder = C.Scratch(spark, "warc").base
    uri = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    make_folder(spark, uri)
    written = write_archives(spark, pages, uri, min_bytes=min_bytes)
    written.agg(F.sum("records")).first()  # runs the write
    return read_archives(spark, uri, with_payload=False).drop("payload", "target_uri")


def make_folder(spark: SparkSession, uri: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
