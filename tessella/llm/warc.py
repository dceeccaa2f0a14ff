"""WARC archives compressed with a Zstandard dictionary (.warc.zst).

An archive's first frame is skippable and holds a dictionary built from the archive's own
first records; every record is a frame of its own. Spark's text writer puts the frames
into files, so any file system that Spark reaches will do and a lost task leaves nothing
behind: the "line separator" is an empty skippable frame. The writer begins a file every
so many frames, and so does the dictionary; an archive that has its bytes before that
is filled up with empty frames. So archives are bounded, and reading one is too.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\0\0\0\0"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: The dictionary's size, and the bytes of records that it is built from at most.
DICTIONARY_BYTES, SAMPLE_BYTES = 32_768, 3_000_000
LEVEL, REVISIT_FROM = 3, 100
#: Frames of an archive, and compressed bytes from which it takes no more records.
ARCHIVE_FRAMES, ARCHIVE_BYTES = 8_192, 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return _header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page)), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _id(refers_to) if revisit else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")], block)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained where the samples suffice, else the samples' first bytes themselves."""
    try:
        if sum(map(len, samples)) >= 8 * size and len(samples) >= 16:
            return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records_: Iterator[bytes], date: str, frames: int = ARCHIVE_FRAMES, most_bytes: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """The frames of archives of so many frames each, the last one excepted."""
    while True:
        waiting, held = [], 0
        for r in records_:
            waiting.append(r)
            held += len(r)
            if held >= SAMPLE_BYTES or len(waiting) >= frames - 2:
                break
        if not waiting:
            return
        words = build_dictionary(waiting)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
        data = words.as_bytes()
        info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info:archive>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        yield DICTIONARY_MAGIC + struct.pack("<I", len(data)) + data
        n, size = 1, len(data)
        for r in itertools.chain([info], waiting, records_):
            frame = zip_.compress(r)
            yield frame
            n, size = n + 1, size + len(frame)
            if n > len(waiting) + 1 and size >= most_bytes:
                yield from itertools.repeat(EMPTY_FRAME.encode(), frames - n)
                n = frames
            if n == frames:
                break
        else:
            return


def _frames(date: str, frames: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for lo in range(0, len(b), 200) for r in b.slice(lo, 200).to_pylist())
        made = (record(r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"], date) for r in rows)
        waiting, held = [], 0
        for frame in archives(made, date, frames, most_bytes):
            waiting.append(frame)
            held += len(frame)
            if len(waiting) >= 1000 or held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], names=["frame"])
                waiting, held = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], names=["frame"])

    return run


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest, refers_to.

    Of rows with equal payloads of at least ``revisit_from`` bytes, those with the smallest
    page_id are responses and the others revisit it. Null html is an empty payload. Rows
    without page_id revisit one that has it; if none has, they are all responses.
    """
    own = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    slim = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).where(F.octet_length("payload") >= revisit_from)
    first = slim.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    met = own.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    return met.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", archive_frames: int = ARCHIVE_FRAMES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """.warc.zst files of bounded size in ``path``, a folder of any file system that Spark knows.

    Spark's writer names its files part-*.txt; name_archives() renames them at the end, and can be called
    again if the driver was lost in between. Until then read_archives() refuses the folder.

    Every row becomes a record, repeated rows too, each response or revisit as in
    plan_records(); null urls have no target, a null page_id an empty one.
    """
    spark = pages.sparkSession
    frames = plan_records(pages).mapInArrow(_frames(date, archive_frames, archive_bytes), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", archive_frames).text(path)
    name_archives(spark, path)


def _unnamed(spark: SparkSession, path: str) -> tuple[list, object]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getPath().getName().endswith(".txt")], files


def name_archives(spark: SparkSession, path: str) -> None:
    """Gives the written files of a folder their names, those that have none yet."""
    found, files = _unnamed(spark, path)
    for f in found:
        files.rename(f, f.getParent().suffix("/" + f.getName().removesuffix(".txt") + ".warc.zst"))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends."""
    head = bytes(data[at : at + 18])
    if head[:4] != FRAME_MAGIC:
        if head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
            return at + 8 + struct.unpack("<I", head[4:8])[0]
        raise ValueError(f"no frame at byte {at}")
    checksum, at = 4 * (head[4] >> 2 & 1), at + zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + checksum


def records(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of one archive."""
    view, at, zip_ = memoryview(data).cast("B"), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if view[at : at + 4] == DICTIONARY_MAGIC:
            raw = bytes(view[at + 8 : end])
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            zip_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        elif view[at : at + 4] == FRAME_MAGIC:
            head, _, rest = zip_.decompress(view[at:end]).partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
            yield fields, rest[: int(fields["content-length"])]
        at = end


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for data in b.column("content"):
            rows = []
            for fields, block in records(data.as_buffer()):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size, digest = int(re.search(rb"Content-Length: (\d+)", head)[1]), fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each response and revisit.

    A response whose payload doesn't have its recorded digest is an error, and so are files that
    write_archives() has not named.
    """
    if _unnamed(spark, path)[0]:
        raise ValueError(f"{path} has archives without their names: call name_archives()")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
